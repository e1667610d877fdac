"""The contexts of symbols: ranked code, callers and callees, tests, knowledge and impact within a token budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prose import adds_context, for_context
from ..functions.text import OVERHEAD_TOKENS, estimate_tokens, impact_line_tokens, snippet_tokens
from ..session import materialized
from . import rank, traverse
from .contain import contained
from .graph import links
from .nearest import nearest_to_each
from .pages import best_page, smallest_page

# Budgets, depths, caps and headings must equal the reference's for equal packing.
IMPACT_HEAD = "## Impact\n\nSymbols affected if this changes:\n\n"
TESTS, RELATED, SEMANTIC, ONBOARD_SNIPPETS, PLAN_TOKENS_A_LINE = 8, 10, 5, 3, 40


@dataclass(frozen=True)
class Task:
    name: str
    budget: int
    depth: int
    cap: int
    snippets: int | None


TASKS = {"fix": Task("Fix", 6000, 2, 20, None), "refactor": Task("Refactor", 12000, 5, 30, None), "onboard": Task("Onboard", 8000, 1, 10, ONBOARD_SNIPPETS)}


def task_of(name: str | None) -> Task:
    """Refactor or onboard; anything else is a fix."""
    return TASKS.get((name or "").strip().lower(), TASKS["fix"])


def _place(row) -> str:
    return f"{row['file_path']}:{row['start_line']}-{row['end_line']}"


def alike(name: Column, names: list[str]) -> Column:
    """Whether a name holds one of the names or lies within it, in any case."""
    lowered, near = F.lower(name), F.array(*(F.lit(n.lower()) for n in names))
    return F.exists(near, lambda n: lowered.contains(n) | n.contains(lowered))


def _firsts(rows: DataFrame, key: str) -> DataFrame:
    """The first TESTS rows of a key, by id."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("turn") <= TESTS).drop("turn")


def _tests_of_names(symbols: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different (root, name) of names, in lower case, and for each name (name, id): the first TESTS symbols of test files, by id, whose name holds
    it or lies within it.

    Different names meet once, however many symbols have them, and at every step no name keeps more than its first TESTS."""
    path = F.lower("file_path")
    tests = materialized(_firsts(symbols.where(path.contains("test") | path.contains("spec")).select(F.lower("name").alias("test"), "id"), "test"))
    asked = materialized(names.select("root", F.lower("name").alias("name")).distinct())
    ours, theirs = asked.select(F.col("name").alias("text")), tests.select(F.col("test").alias("text"))
    needle = lambda rows: rows.withColumnRenamed("text", "needle")
    pairs = contained(needle(ours), theirs).toDF("name", "test").unionByName(contained(needle(theirs), ours).toDF("test", "name")).distinct()
    # A name's first tests belong to the test names whose own first tests come first.
    nearest_names = _firsts(pairs.join(tests.groupBy("test").agg(F.min("id").alias("id")), "test"), "name").select("name", "test")
    return asked, _firsts(nearest_names.join(tests, "test").select("name", "id"), "name")


def related_tests(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(root, id): for each root of names (root, name) the first TESTS symbols of test files, by id, whose name holds one of the root's names or
    lies within it, in any case.

    To a root moves one array for each of its names; they become rows only where the root's arrays have met."""
    asked, met = _tests_of_names(symbols, names)
    lists = met.groupBy("name").agg(F.collect_list("id").alias("ids"))
    at_root = asked.join(lists, "name").select("root", "ids").repartition("root")
    return _firsts(at_root.select("root", F.explode("ids").alias("id")).distinct(), "root")


def _page_of(pages: DataFrame, roots: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    """(root, page): for each root the best page that has it, or of these kinds the one with the fewest symbols."""
    rows = pages.where(F.col("id") != "wiki_index").select(F.col("id").alias("page"), "kind", F.size("symbol_ids").alias("symbols"), F.explode("symbol_ids").alias("id"))
    met = rows.join(roots.select(F.col("root").alias("id")), "id", "left_semi")
    best = best_page(met) if kinds is None else smallest_page(met.where(F.col("kind").isin(*kinds)))
    return best.withColumnRenamed("id", "root").select("root", "page")


def _bodies(pages: DataFrame) -> DataFrame:
    """(page, body): the text of each page for a context where that adds something."""
    text = for_context(F.col("body"))
    return pages.select(F.col("id").alias("page"), F.when(adds_context(text), text).alias("body"))


def _sides(tables: dict[str, DataFrame], of: DataFrame) -> DataFrame:
    """(root, side, other, other_name): callers and callees that are symbols."""
    named = tables["symbols"].select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    met = traverse.neighbours(links(tables["edges"], "calls"), of.withColumnRenamed("root", "node"))
    return materialized(met.withColumnRenamed("node", "root").join(named, "other"))


def _pages(tables: dict[str, DataFrame], of: DataFrame, task: Task) -> dict[str, DataFrame]:
    """The pages (root, page) of a context by the names of their columns."""
    kinds = {"wiki": None} | ({"flow_wiki": ("flow",)} if task.name == "Onboard" else {})
    return {name: materialized(_page_of(tables["pages"], of, kind)) for name, kind in kinds.items()}


CODE = "id string, name string, file_path string, start_line int, end_line int, language string, content string"


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each symbol of a file, which is split once: the least of its last line and the file's, without carriage returns; a final line break makes no empty line."""
    for batch in batches:
        rows = []
        for file in batch.to_pylist():
            lines = [line.removesuffix("\r") for line in (file["text"] or "").removesuffix("\n").split("\n")] if file["text"] is not None else []
            for m in file["members"]:
                first, last = m["start_line"], min(m["end_line"] or 0, len(lines))
                if first and 1 <= first <= last:
                    rows.append(m | {"file_path": file["file_path"], "language": file["language"], "content": "\n".join(lines[first - 1 : last])})
        names = [c.split()[0] for c in CODE.split(", ")]
        kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in CODE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


def code_of(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols (id, name, file_path, start_line, end_line) with language, content and tokens; without those whose lines aren't there."""
    members = symbols.groupBy("file_path").agg(F.collect_list(F.struct("id", "name", "start_line", "end_line")).alias("members"))
    code = members.join(files.select(F.col("path").alias("file_path"), "language", "text"), "file_path").mapInArrow(_sliced, CODE)
    return code.withColumn("tokens", snippet_tokens(F.col("name"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("language"), F.col("content")))


def _listed(value: Column, order: Column, name: str) -> Column:
    """Values in an order, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"]).alias(name)


#: Priorities above this stand in the upper half of a candidate's place, its order among those of its priority in the lower half.
LOWER = 1 << 32
PLACE = ("id", "name", "file_path", "start_line", "end_line")


def _candidates(of: DataFrame, sides: DataFrame, semantic: DataFrame, reached: DataFrame, task: Task) -> DataFrame:
    """(root, id, priority, n, depth): the symbol itself, callers, callees, alike ones, affected ones (with their depth); `n` places those of one priority.
    Tests, of priority 3 in a fix, come by their names. A root that it affects itself has no priority there."""
    later = 4 if task.name == "Fix" else 3
    row = lambda rows, id_, priority, n, depth=None: rows.select("root", F.col(id_).alias("id"), priority.cast("int").alias("priority"), n.cast("int").alias("n"), F.lit(None).cast("int").alias("depth") if depth is None else depth)
    of_depth = F.col("depth").cast("int").alias("depth")
    return reduce(DataFrame.unionByName, [
        row(of, "root", F.lit(0), F.lit(0)),
        row(sides, "other", F.when(F.col("side") == "caller", 1).otherwise(2), F.lit(0)),
        row(semantic, "id", F.lit(later), F.col("rank")),
        row(reached, "node", F.when(F.col("node") != F.col("root"), later + 1), F.col("depth"), of_depth),
    ])


def budgeted(tables: dict[str, DataFrame], roots: DataFrame, semantic: DataFrame, task: Task, budget: int | None = None, plan: bool = False) -> DataFrame:
    """What the contexts of many symbols hold within a budget, and what they would need, without any text: a row for each of `roots`. Tables and choices are those of `assemble`.

    (root, asked, advised, n_snippets, fit, n_lines, shown, within, kept, affected, tests): the budget, what would be enough, candidates with code and how many of
    them fit, affected symbols and how many are shown, whether nothing is missing; kept: (rank, id), affected: (rank, id, depth, tokens), tests: ids, in order."""
    of = roots.select(F.col("id").alias("root"))
    return _budgeted(tables, roots, _sides(tables, of), _pages(tables, of, task), semantic, task, budget, plan)


def _budgeted(tables: dict[str, DataFrame], roots: DataFrame, sides: DataFrame, pages: dict[str, DataFrame], semantic: DataFrame, task: Task, budget: int | None, plan: bool) -> DataFrame:
    """Candidates take what they cost from a table by id, and then all that a root has moves to it once: rows of a candidate and a list of tests
    for each of its names. The rest are windows over the roots where they are, so nothing of a root is held together but what its budget holds."""
    symbols, of = tables["symbols"], roots.select(F.col("id").alias("root"))
    reached = materialized(traverse.reachable(links(tables["edges"]), of, task.depth))
    near = _candidates(of, sides, semantic, reached, task)
    wanted = near.select("id")
    if task.name == "Fix":
        names = roots.select(F.col("id").alias("root"), "name").unionByName(sides.select("root", F.col("other_name").alias("name")))
        asked, met = _tests_of_names(symbols, names)
        met = materialized(met)
        wanted = wanted.unionByName(met.select("id"))
    known = symbols.join(wanted.distinct(), "id", "left_semi").select(*PLACE)
    if plan:
        cost = known.select("id", estimate_tokens(F.repeat(F.lit("x"), (F.col("end_line") - F.col("start_line") + 1) * PLAN_TOKENS_A_LINE)).alias("tokens"))
    else:
        cost = code_of(known, tables["files"]).select("id", "tokens")
    line = impact_line_tokens(F.col("name"), F.col("file_path"), F.col("start_line"), F.col("end_line"))
    facts = materialized(known.select("id", line.alias("line"), F.lit(True).alias("known")).join(cost.withColumn("costed", F.lit(True)), "id", "left"))

    head, none = estimate_tokens(F.lit(IMPACT_HEAD)), lambda kind: F.lit(None).cast(kind)
    rows = near.join(facts, "id", "left").where("depth is null or known").drop("known")
    bodies = _bodies(tables["pages"])
    for name, title in (("wiki", "## Knowledge\n\n"), ("flow_wiki", "## Flow overview\n\n")):
        tokens = F.when(F.coalesce("body", F.lit("")) != "", estimate_tokens(F.col("body")) + estimate_tokens(F.lit(title))).otherwise(0).alias(f"{name}_tokens")
        if name in pages:
            rows = rows.unionByName(pages[name].join(bodies.select("page", tokens), "page").drop("page"), allowMissingColumns=True)
        else:
            rows = rows.withColumn(f"{name}_tokens", none("long"))
    fields = [c for c in rows.columns if c != "root"]
    if task.name == "Fix":
        lists = met.join(facts.select("id", "tokens", "costed"), "id", "left").groupBy("name").agg(F.collect_list(F.struct("id", "tokens", "costed")).alias("list"))
        rows = rows.unionByName(asked.join(lists, "name").select("root", "list"), allowMissingColumns=True).repartition("root")
        of_kind = dict(rows.dtypes)
        fixed = {"priority": F.lit(3), "n": F.lit(0)}
        member = lambda t: F.struct(*(t[c].alias(c) if c in ("id", "tokens", "costed") else fixed.get(c, none(of_kind[c])).cast(of_kind[c]).alias(c) for c in fields))
        rows = rows.select("root", F.inline(F.when(F.col("list").isNotNull(), F.transform("list", member)).otherwise(F.array(F.struct(*fields)))))
        rows = rows.groupBy("root", "priority", "n", "id").agg(*(F.max(c).alias(c) for c in fields if c not in ("id", "priority", "n")))
        turn = F.row_number().over(Window.partitionBy("root", "priority").orderBy("id"))
        rows = rows.withColumn("turn", turn).where(~F.col("priority").eqNullSafe(3) | (F.col("turn") <= TESTS)).drop("turn").withColumn("test", F.col("priority").eqNullSafe(3))
    else:
        rows = rows.repartition("root").withColumn("test", F.lit(False))
    # As one number, a place has its minimum without a sort.
    rows = rows.withColumn("place", F.col("priority").cast("long") * LOWER + F.col("n")).drop("priority", "n")
    if not plan:
        rows = rows.groupBy("root", "id").agg(F.min("place").alias("place"), *(F.max(c).alias(c) for c in rows.columns if c not in ("root", "id", "place")))
    by = Window.partitionBy("root").orderBy(F.col("place").asc_nulls_last(), "id")
    at, deep = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("root").orderBy(F.col("depth").asc_nulls_last(), "id").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("root")
    item = F.col("place").isNotNull() & F.coalesce("costed", F.lit(False))
    if plan:
        rows = rows.withColumn("before", F.lag("id").over(by))
        item &= F.col("before").isNull() | (F.col("before") != F.col("id"))
    rows = rows.withColumns({"item": item, "entry": F.col("depth").isNotNull()})
    rows = rows.withColumns({"rank": F.sum(F.when(F.col("item"), 1)).over(at).cast("int"), "run": F.sum(F.when(F.col("item"), F.col("tokens"))).over(at)})
    if task.snippets is not None:
        rows = rows.withColumn("item", F.col("item") & (F.col("rank") <= task.snippets))
    rows = rows.withColumns({"turn": F.sum(F.when(F.col("entry"), 1)).over(deep).cast("int"), "line_run": F.sum(F.when(F.col("entry"), F.col("line"))).over(deep)})

    total = lambda what, condition: F.coalesce(F.sum(F.when(condition, what)).over(whole), F.lit(0).cast("long"))
    one, true = F.lit(1), F.lit(True)
    rows = rows.withColumns({
        "n_lines": total(one, F.col("entry")), "line_tokens": total(F.col("line"), F.col("entry") & (F.col("turn") <= task.cap)),
        "n_snippets": total(one, F.col("item")), "code_tokens": total(F.col("tokens"), F.col("item")),
        "page_tokens": total(F.col("wiki_tokens"), true), "flow_tokens": total(F.col("flow_wiki_tokens"), true),
    })
    needed = F.col("page_tokens") + F.col("flow_tokens") + F.col("line_tokens") + F.when(F.col("n_lines") > 0, head).otherwise(0) + F.col("code_tokens") + F.when(F.col("n_snippets") > 0, estimate_tokens(F.lit("## Code\n\n"))).otherwise(0)
    rows = rows.withColumn("advised", rank.recommended(needed)).withColumn("asked", F.col("advised") if budget is None else F.lit(budget).cast("long"))
    rows = rows.withColumn("left", F.greatest(F.col("asked") - OVERHEAD_TOKENS, F.lit(0)))
    rows = rows.withColumn("left", F.expr("case when page_tokens > 0 and page_tokens <= left then left - page_tokens when left < page_tokens and page_tokens <= asked div 2 then 0 else left end"))
    rows = rows.withColumn("left", F.expr("case when flow_tokens > 0 and flow_tokens <= left then left - flow_tokens else left end"))
    rows = rows.withColumn("listed", F.col("entry") & rank.fits(F.col("line_run"), F.col("turn"), F.col("left"), head, task.cap))
    rows = rows.withColumns({"shown": total(one, F.col("listed")), "shown_tokens": total(F.col("line"), F.col("listed"))})
    rows = rows.withColumn("left", F.greatest(F.col("left") - F.when(F.col("shown") > 0, head + F.col("shown_tokens")).otherwise(0), F.lit(0)))
    rows = rows.withColumn("kept", F.col("item") & rank.fits(F.col("run"), F.col("rank"), F.col("left")))
    sorted_ = lambda condition, value, name: F.array_sort(F.collect_list(F.when(condition, value))).alias(name)
    out = rows.groupBy("root").agg(
        *(F.max(c).alias(c) for c in ("asked", "advised", "n_snippets", "n_lines", "shown")),
        F.count_if("kept").alias("fit"),
        sorted_(F.col("kept"), F.struct("rank", "id"), "kept"),
        sorted_(F.col("listed"), F.struct(F.col("turn").alias("rank"), "id", "depth", F.col("line").alias("tokens")), "affected"),
        sorted_(F.col("test"), F.col("id"), "tests"),
    )
    cut = (F.col("fit") < F.col("n_snippets")) | (F.col("shown") < F.least(F.col("n_lines"), F.lit(task.cap)))
    return out.withColumn("within", ~cut & (F.col("asked") >= F.col("advised")))


def assemble(tables: dict[str, DataFrame], roots: DataFrame, semantic: DataFrame, task: Task, budget: int | None = None, plan: bool = False) -> DataFrame:
    """The contexts of many symbols as one plan: a row for each of `roots` (rows of symbols) with `markdown`. tables: symbols, edges, files, pages;
    semantic: (root, id, rank), the symbols most alike.

    Without a budget the recommended one is taken. A plan has no code: its snippets count by their lines, a symbol that stands in several
    ranks counts in each unless they follow each other, and its text is short. Candidates are rows with their tokens; budgets are columns, packing
    is a running sum, and code is fetched only for what fits. So a root brings to one row what its budget holds, and the names of its
    callers and callees. What several parts of the plan read is written down once."""
    symbols, of = tables["symbols"], roots.select(F.col("id").alias("root"))
    named = symbols.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    sides, pages = _sides(tables, of), _pages(tables, of, task)
    money = materialized(_budgeted(tables, roots, sides, pages, semantic, task, budget, plan))
    place, none = symbols.select(*PLACE), F.lit(None).cast("string")
    entry = F.struct("id", "depth", "name", "file_path", "start_line", "end_line", "tokens")
    listed = money.select("root", F.inline("affected")).join(place, "id").groupBy("root").agg(_listed(entry, F.col("rank"), "affected"))
    if plan:
        code = money.select("root", F.array().cast("array<struct<id string, name string, file_path string, start_line int, end_line int, language string, content string, tokens bigint, rank int>>").alias("snippets"))
    else:
        kept = money.select("root", F.inline("kept"))
        full = kept.join(code_of(place.join(kept.select("id").distinct(), "id", "left_semi"), tables["files"]), "id")
        code = full.groupBy("root").agg(_listed(F.struct("id", "name", "file_path", "start_line", "end_line", "language", "content", "tokens", "rank"), F.col("rank"), "snippets"))
    tests = money.select("root", F.explode("tests").alias("id")) if task.name == "Fix" else None
    money = money.drop("kept", "affected", "tests")
    for name in ("wiki", "flow_wiki"):
        if name in pages:
            money = money.join(pages[name].join(_bodies(tables["pages"]), "page").withColumnsRenamed({"page": f"{name}_page_id", "body": f"{name}_body"}), "root", "left")
        else:
            money = money.withColumns({f"{name}_page_id": none, f"{name}_body": none})

    mates = symbols.select("file_path", "id", "name", "start_line").withColumn("turn", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id"))).where(F.col("turn") <= RELATED + 1)
    mates = roots.select(F.col("id").alias("root"), "file_path").join(mates, "file_path").where("id <> root").groupBy("root").agg(_listed(F.col("name"), F.col("turn"), "related_components"))
    side = sides.groupBy("root").agg(*(_listed(F.when(F.col("side") == s, F.col("other_name")), F.col("other"), s + "s") for s in ("caller", "callee")))
    alike_ones = semantic.join(named.withColumnRenamed("other", "id"), "id").groupBy("root").agg(_listed(F.col("other_name"), F.col("rank"), "semantic_neighbors"))
    out = roots.select(F.col("id").alias("root"), F.struct(*roots.columns).alias("symbol"))
    tested = [tests.join(symbols.select("id", "file_path"), "id").groupBy("root").agg(F.array_sort(F.collect_set("file_path")).alias("related_tests"))] if tests is not None else []
    out = reduce(lambda a, b: a.join(b, "root", "left"), [listed, code, mates, side, alike_ones, *tested], out.join(money, "root"))
    if tests is None:
        out = out.withColumn("related_tests", F.array().cast("array<string>"))
    empty = {c: F.coalesce(c, F.filter(c, lambda _: F.lit(False)), F.array().cast(out.schema[c].dataType)) for c in ("snippets", "affected", "related_components", "callers", "callees", "semantic_neighbors", "related_tests")}
    out, s = out.withColumns(empty), F.col("symbol")
    advice = F.struct(F.col("asked").alias("requested_budget"), F.col("advised").alias("recommended_tokens"), F.lit(0).cast("long").alias("estimated_tokens"), F.col("fit").alias("snippets_included"), (F.col("n_snippets") - F.col("fit")).alias("snippets_omitted"), F.col("shown").alias("impact_entries_shown"), F.col("n_lines").alias("impact_entries_total"), F.col("within").alias("within_budget"))
    texts = {
        "responsibility": F.concat(s["name"], F.lit(" ("), F.initcap(s["kind"]), F.lit(") defined in "), s["file_path"], F.lit(" at lines "), s["start_line"].cast("string"), F.lit("-"), s["end_line"].cast("string")),
        "enriched_summary": none,
        "summary_source": F.lit("deterministic"),
        "external_dependencies": F.slice(F.split(s["file_path"], "/"), 1, 2),
        "invariants": F.array(F.concat(F.lit("visibility: "), F.initcap(s["visibility"]))),
        "budget_advice": advice,
        "task": F.lit(task.name.lower()),
        "budget_tokens": F.col("asked"),
    }
    out = out.withColumns(texts).select(*FIELDS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    out = out.mapInArrow(lambda batches: _rendered(batches, task, plan), f"{schema}, markdown string")
    return out.withColumn("budget_advice", F.col("budget_advice").withField("estimated_tokens", estimate_tokens(F.col("markdown"))))


FIELDS = ("symbol", "responsibility", "enriched_summary", "summary_source", "related_components", "external_dependencies", "invariants", "semantic_neighbors", "snippets", "callers", "callees", "related_tests", "affected", "wiki_page_id", "wiki_body", "flow_wiki_page_id", "flow_wiki_body", "budget_advice", "task", "budget_tokens")


def _rendered(batches: Iterator[pa.RecordBatch], task: Task, plan: bool) -> Iterator[pa.RecordBatch]:
    """Rows with their document."""
    for batch in batches:
        texts = [plan_markdown(c, task) if plan else markdown(c, task) for c in batch.to_pylist()]
        yield batch.append_column("markdown", pa.array(texts, pa.string()))


def semantic_to_each(embeddings: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, rank): the SEMANTIC nearest other symbols of each root."""
    rows = embeddings.withColumnRenamed("symbol_id", "id")
    met = nearest_to_each(rows.join(roots.select("id"), "id", "left_semi"), rows, SEMANTIC)
    return met.select(F.col("id").alias("root"), F.col("near").alias("id"), "rank")


def _notice(advice: dict) -> str:
    omitted, shown, total = advice["snippets_omitted"], advice["impact_entries_shown"], advice["impact_entries_total"]
    detail = f" ({omitted} snippet(s) omitted{f', impact truncated to {shown}' if shown < total else ''})" if omitted else f" (impact truncated to {shown} of {total})" if shown < total else ""
    return f"> **Budget notice:** The requested budget may be too small for this symbol and task. Used ~{advice['estimated_tokens']} tokens; recommended ~{advice['recommended_tokens']} tokens{detail}. Re-run with `--auto-budget` or `--budget {advice['recommended_tokens']}`.\n\n"


def _ended(text: str) -> str:
    return text if text.endswith("\n") else text + "\n"


def markdown(c: dict, task: Task) -> str:
    """A context as one document; sections without content are left out."""
    out = [f"# Context: {c['symbol']['name']}\n\n**Task:** {task.name}\n\n"]
    if not c["budget_advice"]["within_budget"]:
        out.append(_notice(c["budget_advice"]))
    out.append(f"## Symbol\n\n{c['responsibility']}\n")
    for head, key in (("Flow overview", "flow_wiki"), ("Knowledge", "wiki")):
        if c[f"{key}_body"]:
            out.append(f"\n## {head}\n\n_Grounded markdown: `{c[f'{key}_page_id']}`_\n\n{_ended(c[f'{key}_body'])}\n")
    if c["snippets"]:
        code = (f"### {s['name']} (`{_place(s)}`)\n\n```{s['language']}\n{_ended(s['content'])}```\n\n" for s in c["snippets"])
        out.append("\n## Code\n\n" + "".join(code))
    if c["related_tests"]:
        out.append("## Related tests\n\n" + "".join(f"- `{p}`\n" for p in c["related_tests"]) + "\n")
    if c["callers"] or c["callees"]:
        out.append("## Call graph\n\n" + "".join(f"**{side.capitalize()}:** {', '.join(c[side])}\n\n" for side in ("callers", "callees") if c[side]))
    if c["budget_advice"]["impact_entries_shown"]:
        more = c["budget_advice"]["impact_entries_total"] - c["budget_advice"]["impact_entries_shown"]
        rest = f"\n_…and {more} more (increase `--budget` or use `--auto-budget`)_\n" if more else ""
        out.append(IMPACT_HEAD + "".join(f"- **{r['name']}** — `{_place(r)}`\n" for r in c["affected"]) + rest + "\n")
    if c["related_components"]:
        out.append(f"## Related in module\n\n{', '.join(c['related_components'])}\n")
    return "".join(out)


def refreshed(c: dict, task: Task) -> dict:
    """A context after its texts changed, rendered anew. As only the symbol itself is at hand then, no other is listed under impact."""
    out = c | {"affected": [r for r in c["affected"] if r["id"] == c["symbol"]["id"]]}
    return out | {"markdown": markdown(out, task)}


def plan_markdown(c: dict, task: Task) -> str:
    """What a context would hold and need."""
    a = c["budget_advice"]
    facts = {"Recommended": f"~{a['recommended_tokens']} tokens", "Default for task": f"{task.budget} tokens", "Candidate snippets": a["snippets_included"] + a["snippets_omitted"], f"Impact symbols (depth {task.depth})": a["impact_entries_total"]}
    tests = "\n## Related tests\n\n" + "".join(f"- `{p}`\n" for p in c["related_tests"]) if c["related_tests"] else ""
    listed = "".join(f"- **{k}:** {v}\n" for k, v in facts.items())
    return f"# Context plan: {c['symbol']['name']}\n\n**Task:** {task.name}\n\n## Budget guidance\n\n{listed}{tests}\n_Re-run without `--plan` for the full bundle._\n"
