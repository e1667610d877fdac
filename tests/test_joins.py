"""Joins by containment, by path patterns and by sorted digests, against plain Python."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import matches_glob
from graphloom.operators import context, link, pages
from graphloom.operators.contain import contained
from graphloom.operators.context import related_tests
from graphloom.operators.paths import matched


def test_contained_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé_") for _ in range(rng.randint(1, 9)))
    needles, texts = [word()[:5] for _ in range(80)], [word() for _ in range(150)]
    got = contained(spark.createDataFrame([(x,) for x in [*needles, None, "", "zzz"]], "needle string"), spark.createDataFrame([(x,) for x in [*texts, None, ""]], "text string")).collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == {(a, b) for a in needles for b in texts if a in b}


def test_related_tests_keep_the_first_eight(spark):
    rows = [(f"i{n:02}", f"Test_order_{n}", "src/order_test.rs") for n in range(12)] + [("a1", "order", "src/a.rs"), ("a2", "o", "spec/b.rs"), ("a3", "pay", "src/test_pay.rs")]
    symbols = spark.createDataFrame(rows, "id string, name string, file_path string")
    names = spark.createDataFrame([("r", "ORDER"), ("r", "order_1"), ("q", "repay"), ("s", "nothing")], "root string, name string")
    got = {}
    for r in related_tests(symbols, names).collect():
        got.setdefault(r.root, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {"r": ["a2", *(f"i{n:02}" for n in range(7))], "q": ["a3"]} | ({"s": ["a2"]} if "o" in "nothing" else {})


def test_related_tests_move_a_list_for_each_name(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aB_") for _ in range(rng.randint(1, 5)))
    rows = [(f"i{n:03}", word(), rng.choice(["src/a.rs", "tests/b.rs"])) for n in range(120)]
    asked = [(f"r{n % 20}", word()) for n in range(60)] + [("none", None)]
    met = related_tests(spark.createDataFrame(rows, "id string, name string, file_path string"), spark.createDataFrame(asked, "root string, name string"))
    holds = lambda a, b: a.lower() in b.lower() or b.lower() in a.lower()
    of = lambda root: sorted(i for i, name, path in rows if "test" in path and any(n and r == root and holds(n, name) for r, n in asked))[:8]
    assert sorted(map(tuple, met.collect())) == sorted((root, i) for root in {r for r, _ in asked} for i in of(root))
    assert not re.search(r"hashpartitioning\(root#\d+L?, id#", met._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize(("task", "budget", "plan"), [("fix", 330, False), ("onboard", None, True)])
def test_what_a_root_has_moves_to_it_once(spark, task, budget, plan):
    rng = random.Random(9)
    ids = [f"s{i:02}" for i in range(30)]
    symbols = spark.createDataFrame([(i, rng.choice("abc"), "function", rng.choice(["src/a.rs", "tests/b.rs"]), n % 20 + 1, n % 20 + 2, "public") for n, i in enumerate(ids)], "id string, name string, kind string, file_path string, start_line int, end_line int, visibility string")
    tables = {
        "symbols": symbols,
        "edges": spark.createDataFrame([(rng.choice(ids), rng.choice([*ids, "lost"]), "calls") for _ in range(60)], "src_symbol_id string, dst_symbol_id string, edge_type string"),
        "files": spark.createDataFrame([(p, "rust", "let x;\n" * 30) for p in ("src/a.rs", "tests/b.rs")], "path string, language string, text string"),
        "pages": spark.createDataFrame([("p", "flow", "words " * 20, ids[::3])], "id string, kind string, body string, symbol_ids array<string>"),
    }
    semantic = spark.createDataFrame([(i, rng.choice(ids), 1) for i in ids], "root string, id string, rank int")
    met = context.budgeted(tables, symbols, semantic, context.task_of(task), budget, plan)
    assert len(re.findall(r"Exchange hashpartitioning\(root#", met._jdf.queryExecution().executedPlan().toString())) == 1
    whole = {r["symbol"]["id"]: r for r in context.assemble(tables, symbols, semantic, context.task_of(task), budget, plan).collect()}
    rows = met.collect()
    assert len(rows) == len(ids) == len(whole)
    for r in rows:
        full = whole[r["root"]]
        advice, listed = full["budget_advice"], [x["id"] for x in full["affected"]]
        assert (r["asked"], r["advised"], r["fit"], r["shown"], r["n_lines"], r["within"]) == (advice["requested_budget"], advice["recommended_tokens"], advice["snippets_included"], advice["impact_entries_shown"], advice["impact_entries_total"], advice["within_budget"])
        assert [x["id"] for x in r["affected"]] == listed and (plan or [x["id"] for x in r["kept"]] == [x["id"] for x in full["snippets"]])


def test_patterns_equal_the_glob_predicate(spark):
    rng = random.Random(7)
    part = lambda: rng.choice(["a", "ab", "abc", "b", "é"])
    files = ["/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["/x", "a/", ""]
    patterns = ["/".join(part() for _ in range(rng.randint(1, 3))) + rng.choice(["", "/**", "*", "/*", "*b", "/"]) for _ in range(60)] + ["*", "**", "/**", ""]
    left = spark.createDataFrame([(f,) for f in [*files, None]], "path string")
    right = spark.createDataFrame([*enumerate(patterns), (99, None)], "k int, pattern string")
    want = left.distinct().crossJoin(right).where(matches_glob(F.col("path"), F.col("pattern"))).select("k", "path").collect()
    got = matched(left, right, "k").collect()
    assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == {tuple(r) for r in want}


def test_many_patterns(spark):
    """A hundred thousand patterns are rows of a join, not a part of the plan."""
    patterns = spark.range(100_000).select(F.col("id").alias("k"), F.format_string("src/m%d/f%d.rs", F.col("id") % 500, "id").alias("pattern"))
    files = patterns.where("k % 10 = 0").select(F.col("pattern").alias("path")).unionByName(spark.range(500).select(F.format_string("src/m%d/other.rs", "id").alias("path")))
    met = matched(files, patterns.unionByName(spark.range(500).select((100_000 + F.col("id")).alias("k"), F.format_string("src/m%d/**", "id").alias("pattern"))), "k")
    assert met.count() == 10_000 + 10_000 + 500


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_digests_over_batches(size):
    rng = random.Random(5)
    rows = sorted({(rng.choice("pqr"), f"{rng.randint(0, 30)}->{rng.randint(0, 9)}", True) for _ in range(200)} | {(p, str(n), False) for p in "pqr" for n in range(3)})
    doubled = sorted(rows + [r for r in rows if r[2] and rng.random() < 0.5])
    table = pa.table({name: [r[i] for r in doubled] for i, name in enumerate(("page", "line", "edge"))})
    got = {r["page"]: r["fingerprint"] for b in pages._digests(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()}
    assert got == {p: hashlib.sha256("\n".join(line for q, line, _ in rows if q == p).encode()).hexdigest() for p in "pqr"}
    assert list(pages._digests(iter([]))) == []


def test_links_of_one_name_are_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(link, "PIECE", 16)
    monkeypatch.setattr(link, "TASK_PAIRS", 256)
    ends = lambda n, of: [(i % 3, i, "hot") for i in range(n)] + [(1, n, of), (2, n + 1, None)]
    left, right = ends(100, "one"), ends(60, "other")
    a, b = spark.createDataFrame(left, "repo int, symbol int, name string"), spark.createDataFrame(right, "repo int, symbol int, name string")
    met = link.by_name(a.withColumn("more", F.col("symbol") * 2), b, "name")
    got = [tuple(r) for r in met.select("src_repo", "src", "dst_repo", "dst", "name", "more").collect()]
    want = [(r, s, q, t, n, 2 * s) for r, s, n in left for q, t, m in right if n is not None and n == m and r != q]
    assert sorted(got) == sorted(want)
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < len(want) / 4


def test_links_repeat_pieces_not_ends(spark, monkeypatch):
    """What is repeated for the cells are arrays of ends, after they were dealt out."""
    monkeypatch.setattr(link, "PIECE", 16)
    ends = spark.range(100).select((F.col("id") % 3).alias("repo"), F.col("id").alias("symbol"), F.lit("hot").alias("name"))
    plan = link.by_name(ends, ends, "name")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    repeated = [i for i, line in enumerate(plan) if "explode(sequence(" in line]
    assert len(repeated) == 2 and all("collect_list(struct(" in "".join(plan[i + 1 : i + 4]) for i in repeated)


@pytest.mark.parametrize(("piece", "turn"), [(16, 5), (7, 64), (1, 1)])
def test_links_in_turns_equal_all_pairs(spark, monkeypatch, piece, turn):
    """Ends that occur twice, unknown ends and pieces that are no whole turns keep their rows."""
    monkeypatch.setattr(link, "PIECE", piece)
    monkeypatch.setattr(link, "TURN", turn)
    monkeypatch.setattr(link, "TASK_PAIRS", 64)
    rng = random.Random(piece)
    ends = lambda n: [(rng.choice([0, 1, 2, None]), rng.choice([*range(20), None]), rng.choice(["a", "b", None])) for _ in range(n)]
    left, right = ends(50), ends(33)
    a, b = (spark.createDataFrame(rows, "repo int, symbol int, name string") for rows in (left, right))
    met = link.by_name(a.withColumn("more", F.create_map("name", "symbol")), b, "name").select("src_repo", "src", "dst_repo", "dst", "name", "more")
    want = [(r, s, q, t, n, {n: s}) for r, s, n in left for q, t, m in right if n is not None and n == m and None not in (r, q) and r != q]
    assert sorted(map(str, map(tuple, met.collect()))) == sorted(map(str, want))


def test_links_are_few_bytes_in_a_file(spark, tmp_path):
    ends = lambda n: spark.range(n).select((F.xxhash64("id") % 25).alias("repo"), F.col("id").alias("symbol"), F.format_string("name%d", F.col("id") % 2).alias("name"))
    link.by_name(ends(1500), ends(2500), "name").write.parquet(f"{tmp_path}/links")
    size = sum(f.stat().st_size for f in tmp_path.glob("links/*.parquet"))
    assert size < 0.4 * spark.read.parquet(f"{tmp_path}/links").count()


def test_see_also_moves_lists_even_of_common_symbols(spark, monkeypatch):
    monkeypatch.setattr(pages, "PIECE", 8)
    rng = random.Random(4)
    rows = [(p, 0) for p in range(50)] + [(rng.randrange(60), rng.randrange(1, 40)) for _ in range(150)] + [(70, 99), (None, 0), (71, None), (3, 0)]
    got = {r["page"]: r["others"] for r in pages.see_also(spark.createDataFrame(rows, "page int, id int")).collect()}
    known = {(p, i) for p, i in rows if p is not None and i is not None}
    want = {p: sorted({str(q) for q, j in known for r, i in known if r == p and i == j and q != p}) for p in {p for p, _ in known}}
    assert got == {p: o for p, o in want.items() if o}


@pytest.mark.parametrize(("piece", "block"), [(1024, 50), (5, 50), (5, 1 << 23), (1024, 1 << 23)])
def test_see_also_in_blocks_equals_all_pairs(spark, monkeypatch, piece, block):
    """Pages are strings or numbers, rows may repeat, and blocks and lists cut through a symbol's pages."""
    monkeypatch.setattr(pages, "PIECE", piece)
    monkeypatch.setattr(pages, "BLOCK", block)
    rng = random.Random(block)
    rows = [(rng.randrange(80), rng.choice([*range(30), None])) for _ in range(200)] + [(p, 99) for p in range(0, 80, 3)]
    for kind, of in (("int", int), ("string", "wiki_{}".format)):
        members = [(of(p), None if i is None else of(i)) for p, i in [*rows, *rows[:50]]]
        got = [tuple(r) for r in pages.see_also(spark.createDataFrame(members, f"page {kind}, id {kind}")).collect()]
        known = {(p, i) for p, i in members if i is not None}
        want = {p: sorted({str(q) for q, j in known for r, i in known if r == p and i == j and q != p}) for p, _ in known}
        assert sorted(got, key=str) == sorted(((p, o) for p, o in want.items() if o), key=str)


def _written(plan):
    """(partitioning, rows) of the exchanges of a plan that ran."""
    found, left = [], [plan.executedPlan() if hasattr(plan, "executedPlan") else plan]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append((node.outputPartitioning().toString(), node.metrics().apply("shuffleRecordsWritten").value()))
        if name.endswith("QueryStageExec"):
            left.append(node.plan())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return found


def test_see_also_moves_a_list_once_to_a_block_of_pages(spark, monkeypatch):
    monkeypatch.setattr(pages, "BLOCK", 4000)
    members = spark.range(2000).select((F.col("id") / 4).cast("long").alias("page"), ((F.col("id") / 400).cast("long") * 20 + F.xxhash64("id") % 20).alias("id"))
    met = pages.see_also(members)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3 and "hashpartitioning(page" not in plan
    met.collect()
    moved = [n for by, n in _written(met._jdf.queryExecution().executedPlan()) if "passthrough" in by]
    assert len(moved) == 1 and 0 < moved[0] < members.distinct().count() / 2


def test_claims_are_looked_up_without_all_edges_in_both_directions(spark):
    claimed = spark.createDataFrame([(1, 2, 1), (2, 5, 5), (3, 5, None), (4, None, 5), (5, 1, 3), (6, 4, 4), (7, 3, 9), (7, 3, 9)], "page int, src int, dst int")
    edges = spark.createDataFrame([(1, 2), (1, 2), (9, 3), (5, 5), (4, None), (3, 2)], "src int, dst int")
    met = pages.wrong_claims(claimed, edges)
    assert sorted(map(tuple, met.collect()), key=str) == sorted([(3, 5, None), (4, None, 5), (5, 1, 3), (6, 4, 4)], key=str)
    assert "Union" not in met._jdf.queryExecution().optimizedPlan().toString()
