"""The library's face: builds the state of a source tree and answers questions about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.prose import SLOT, adds_context, for_context, keep_prose, prose, with_prose
from .functions.text import parent_dir, redact, stable_id
from .operators import compile as compiled
from .operators import context as contexts
from .operators import graph, traverse, vectors
from .operators.state import changes, upsert
from .session import materialized
from .sources import parse, tree
from .sources.store import INDEX, NotBuilt, Store, read_text

DOMAIN = "id string, name string, source string, user_confirmed boolean"
MEMBER = "domain_id string, member_kind string, member_value string"
CACHE = "entity_kind string, entity_id string, summary string, source string"
#: Tables that an incremental build goes on from.
KEPT = ("files", "parsed", "symbols", "references", "entrypoints", "embeddings")
SUGGESTIONS, PROMPT_CHARS = 5, 1200
SYMBOL_JSON = {"file_path": "filePath", "start_line": "startLine", "end_line": "endLine", "module_id": "moduleId"}
EDGE_JSON = {"src_symbol_id": "srcSymbolId", "dst_symbol_id": "dstSymbolId", "edge_type": "edgeType"}


class NotFound(Exception):
    """No such symbol, page or domain."""


class DomainError(Exception):
    """A change of a domain that can't be made."""


def _renamed(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    return frame.select(*(F.col(c).alias(names.get(c, c)) for c in frame.columns))


class Engine:
    def __init__(self, spark: SparkSession, root: str, folder: str | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root, folder)

    # Building

    def build(self, incremental: bool = True) -> dict[str, int]:
        """Scans and parses the tree and rebuilds everything that follows; counts of what was done.

        An incremental build parses only new and changed files, and keeps files that have gone. Symbols, entry points and embeddings of
        other files stay as they are, and of their references only those to names whose symbols changed are resolved again. A full one
        starts afresh but for the user's domains and the cache of summaries.
        """
        store = self.store
        old = {n: store.table(n) for n in KEPT} if incremental and set(KEPT) <= set(store.tables()) else None
        now = tree.scan(self.spark, store.root)
        if old:
            hashes = lambda files: files.select("path", F.col("content_hash").alias("hash"))
            changed = materialized(changes(hashes(now), hashes(old["files"])).where("change <> 'removed'").select("path"))
        else:
            changed = None
        # A table of the last state without the rows of changed files, and those that files now have.
        joined = lambda name, path, new: graph.without(old[name], changed, path).unionByName(new) if old else new
        fresh = now.join(changed, "path", "left_semi") if old else now
        files = store.stage("files", joined("files", "path", fresh))
        read = files.join(changed, "path", "left_semi") if old else files
        parsed = store.stage("parsed", joined("parsed", "path", parse.parsed(read).join(read.select("path", "content_hash"), "path")))
        part = parsed.join(changed, "path", "left_semi") if old else parsed
        symbols = store.stage("symbols", joined("symbols", "file_path", graph.symbols(part)))
        if old:
            own = symbols.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
            found = graph.advanced(old["references"], part, changed, old["symbols"], symbols)
            # Rows by symbol: those of symbols that the changed files had or have are made anew.
            ids = old["symbols"].join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("symbol_id"))
            rest = lambda name: old[name].join(ids, "symbol_id", "left_anti")
        else:
            own, found, rest = symbols, graph.resolved(graph.references(part), symbols), None
        references = store.stage("references", found)
        edges = store.stage("edges", graph.edges_of(references))
        points = graph.entrypoints(part, own)
        store.stage("entrypoints", rest("entrypoints").unionByName(points) if old else points)
        domains, members = self._kept("domains", DOMAIN), self._kept("members", MEMBER)
        found = graph.with_overrides(graph.flows(symbols, edges), domains, members, symbols, edges)
        flows = store.stage("flows", found)
        confirmed = domains.where("user_confirmed")
        store.stage("domains", upsert(confirmed, flows.join(confirmed.select("id"), "id", "left_anti").select("id", "name", F.lit("auto").alias("source"), F.lit(False).alias("user_confirmed")), "id"))
        store.stage("members", members)
        store.stage("enrichments", self._kept("enrichments", CACHE))
        vector = vectors.symbol_embeddings(own)
        store.stage("embeddings", rest("embeddings").unionByName(vector) if old else vector)
        store.commit()
        self.write_artifacts()
        pages = self.compile()
        report = self.lint()
        new = changed.count() if old else store.rows["files"]
        counts = {name: store.rows[name] for name in ("symbols", "edges", "entrypoints", "flows", "embeddings")}
        return {"files_parsed": new, "files_skipped": store.rows["files"] - new, **counts, "pages": pages, "stale_pages": len(report["stale_page_ids"])}

    def _kept(self, name: str, schema: str) -> DataFrame:
        return self.store.table(name) if name in self.store.tables() else self.spark.createDataFrame([], schema)

    def write_artifacts(self) -> None:
        """The five JSON documents; the architecture has no modules yet."""
        table, write = self.store.table, self.store.write_artifact
        write("symbols", {"symbols": _renamed(table("symbols").orderBy("file_path", "start_line", "id"), SYMBOL_JSON)})
        write("dependencies", {"edges": _renamed(table("edges").orderBy("src_symbol_id", "dst_symbol_id", "edge_type"), EDGE_JSON)})
        write("flows", {"flows": table("flows").orderBy("name", "id")})
        write("entrypoints", {"entrypoints": table("entrypoints").orderBy("symbol_id", "kind", "label")})
        nothing = self.spark.createDataFrame([], "id string")
        write("architecture", {"modules": nothing, "edges": nothing})

    # Pages

    def compile(self, only: list[str] | None = None, keep: bool = False) -> int:
        """Writes pages and the index; with `only` just those ids (an empty list means all). `keep` carries filled prose over."""
        table = self.store.table
        pages = compiled.pages(table("symbols"), table("edges"), table("flows"), table("entrypoints"))
        index = compiled.index(pages)
        if only:
            pages = pages.where(F.col("id").isin(*only))
        if keep:
            old = self.store.pages().select("id", F.col("body").alias("old"))
            pages = pages.join(old, "id", "left").withColumn("body", F.when(F.col("old").isNull(), F.col("body")).otherwise(keep_prose(F.col("old"), F.col("body")))).drop("old")
        pages = self.store.stage("pages", pages.unionByName(index))
        self.store.commit()
        self.store.write_pages(pages)
        return self.store.rows["pages"]

    def stale_queue(self) -> list[str]:
        if read_text(self.spark, f"{self.store.folder}/wiki_stale.json") is None:
            return []
        return [r[0] for r in self.spark.read.json(f"{self.store.folder}/wiki_stale.json", multiLine=True, schema="page_ids array<string>").select(F.explode("page_ids")).collect()]

    def sync(self, only: list[str] | None = None) -> int:
        """Recompiles the given pages, or else the stale ones, and keeps prose; with nothing stale that is all pages."""
        return self.compile(self.stale_queue() if only is None else only, keep=True)

    def lint(self) -> dict[str, list]:
        """What pages on disk get wrong, also written as a report and as the queue of stale pages. `strict_ok` leaves orphans out."""
        report = {k: [r[0] if len(r) == 1 else r.asDict() for r in f.collect()] for k, f in compiled.lint_report(self.store.pages(), self.store.table("edges")).items()}
        frames = {k: self._records(k, v) for k, v in report.items()}
        self.store.write_artifact("wiki_lint", frames)
        self.store.write_artifact("wiki_stale", {"page_ids": frames["stale_page_ids"]})
        return report | {"strict_ok": not (report["stale_page_ids"] or report["claim_errors"] or report["broken_links"])}

    def _records(self, key: str, rows: list) -> DataFrame:
        schema = {"claim_errors": "page_id string, claim string, message string", "broken_links": "page_id string, target string, message string"}.get(key, "page string")
        return self.spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else (r,) for r in rows], schema)

    def page(self, key: str) -> Row:
        """A page by id or file stem, or else the first by id whose id, title or stem has the key in it; with `stale`."""
        pages = self.store.pages()
        if key in ("index", INDEX):
            met = pages.where(F.col("id") == INDEX)
        else:
            stem, wanted = F.regexp_replace("id", "^wiki_", ""), F.lit(key.lower())
            exact = (F.col("id") == key) | (stem == key)
            met = pages.where((F.col("id") != INDEX) & (exact | F.lower("title").contains(wanted) | F.lower(stem).contains(wanted))).orderBy(F.when(exact, 0).otherwise(1), "id")
        found = met.limit(1).collect()
        if not found:
            raise NotFound(f"no page {key}")
        stale = compiled.lint_report(pages.where(F.col("id") == found[0].id), self.store.table("edges"))["stale_page_ids"]
        return Row(**found[0].asDict(), stale=found[0].id != INDEX and not stale.isEmpty())

    def enrich(self, key: str, model: Callable[[str], str] | None = None) -> Row:
        """Fills the prose slot of a page from the cache, or else by the model, whose answer is cached. Without a model and
        a cached answer, without a slot, or with a filled one, the page stays as it is."""
        page = self.page(key)
        if page.stale is None or SLOT not in page.body or not self._row(page).where(prose(F.col("body")).isNull()).count():
            return page
        text = self._summary("wiki", page.id, f"Explain intent and gotchas of {page.title}:\n{page.body[:PROMPT_CHARS]}", model)
        if text is None:
            return page
        filled = self._row(page).withColumn("body", with_prose(F.col("body"), F.lit(text))).withColumn("source", F.lit("mcp_sampling"))
        self.store.write_pages(filled)
        return self.page(page.id)

    def _row(self, page: Row) -> DataFrame:
        return self.store.pages().where(F.col("id") == page.id)

    def _summary(self, kind: str, ident: str, facts: str, model: Callable[[str], str] | None) -> str | None:
        cache = self._kept("enrichments", CACHE)
        known = cache.where((F.col("entity_kind") == kind) & (F.col("entity_id") == ident)).select("summary").collect()
        if known or model is None:
            return known[0][0] if known else None
        prompt = self.spark.range(1).select(redact(F.lit(facts))).first()[0]
        answer = model(prompt)
        row = self.spark.createDataFrame([(kind, ident, answer, "mcp_sampling")], CACHE)
        self.store.stage("enrichments", cache.where(~((F.col("entity_kind") == kind) & (F.col("entity_id") == ident))).unionByName(row))
        self.store.commit()
        return answer

    # Questions

    def symbol(self, name: str) -> Row:
        """The symbol of that name in any case, or else one whose qualified name has it in it (`_` and `%` are wildcards)."""
        found = graph.lookup(self.store.table("symbols"), name).limit(1).collect()
        if not found:
            raise NotFound(f"no symbol {name}")
        return found[0]

    def _reach(self, root: Row, depth: int) -> DataFrame:
        roots = self.spark.createDataFrame([(root.id,)], "root string")
        return traverse.reachable(graph.links(self.store.table("edges")), roots, depth)

    def impact(self, name: str, depth: int = 3) -> dict:
        """What a symbol leads to within a depth: ids, directories in order of appearance, test files, and whether that is many."""
        root = self.symbol(name)
        path = F.col("path")
        nodes = self.store.table("symbols").select("id", parent_dir(F.col("file_path")).alias("module"), F.col("file_path").alias("path"))
        roots = self.spark.createDataFrame([(root.id,)], "root string")
        links = graph.links(self.store.table("edges"))
        met = traverse.impact(links, nodes, roots, depth).first()
        rows = self._reach(root, depth).join(nodes, F.col("node") == F.col("id"), "left").orderBy("depth", "node").select("node", F.when(path.contains("test") | path.contains("spec"), path)).collect()
        risk = [f"{root.name} has {met.affected} downstream dependents within depth {depth}"] if met.risk else []
        return {"symbol": root.asDict(), "affected_symbol_ids": [r[0] for r in rows], "affected_modules": met.modules, "related_tests": sorted(r[1] for r in rows if r[1]), "risk_zones": risk}

    def dependencies(self, name: str, depth: int = 3, upstream: bool = False) -> dict:
        """Ids below a symbol; `upstream` also gives those above, which is otherwise empty."""
        root = self.symbol(name)
        ids = lambda rows: [r.node for r in rows.orderBy("depth", "node").collect()]
        back = graph.links(self.store.table("edges")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        above = ids(traverse.reachable(back, self.spark.createDataFrame([(root.id,)], "root string"), depth)) if upstream else []
        return {"symbol": root.asDict(), "downstream": ids(self._reach(root, depth)), "upstream": above}

    def flow(self, name: str, model: Callable[[str], str] | None = None) -> dict:
        """The flow of that name in any case; without one, up to five symbols whose name has it in it."""
        found = self.store.table("flows").where(F.lower("name") == name.lower()).orderBy("id").limit(1).collect()
        if found:
            flow = found[0].asDict(True)
            text = self._summary("flow", flow["id"], f"Describe the flow {flow['name']} of {len(flow['steps'])} steps.", model)
            return {"flow": flow, "suggestions": [], "enriched_description": text, "description_source": "mcp_sampling" if text else "deterministic"}
        near = self.store.table("symbols").where(F.lower("name").contains(name.lower())).orderBy("file_path", "start_line", "id").limit(SUGGESTIONS).collect()
        return {"flow": None, "suggestions": [r.name for r in near], "enriched_description": None, "description_source": "deterministic"}

    def context(self, name: str, task: str = "fix", budget: int | None = None, auto_budget: bool = False, plan: bool = False, model: Callable[[str], str] | None = None) -> dict:
        """The context of a symbol within a budget: the given one, the recommended one (`auto_budget`), or that of the task.
        With a model, its pages without prose are filled first, as by `enrich`."""
        kind, root = contexts.task_of(task), self.symbol(name)
        tables = {t: self.store.table(t) for t in ("symbols", "edges", "files")} | {"pages": self.store.pages()}
        own = tables["symbols"].where(F.col("id") == root.id)
        asked = None if auto_budget else kind.budget if budget is None else budget
        found = contexts.assemble(tables, own, self._alike(root.id), kind, asked, plan).first().asDict(True)
        ids = self._reach(root, kind.depth).join(tables["symbols"].select(F.col("id").alias("node")), "node", "left_semi").orderBy("depth", "node").collect()
        found["affected_symbol_ids"] = [r.node for r in ids]
        return found if model is None or plan else self._enriched(found, kind, model)

    def contexts(self, task: str = "fix", budget: int | None = None, plan: bool = False) -> DataFrame:
        """The contexts of all symbols, a row each, within a budget (that of the task if none is given)."""
        kind = contexts.task_of(task)
        tables = {t: self.store.table(t) for t in ("symbols", "edges", "files")} | {"pages": self.store.pages()}
        semantic = contexts.semantic_to_each(self.store.table("embeddings"), tables["symbols"])
        return contexts.assemble(tables, tables["symbols"], semantic, kind, kind.budget if budget is None else budget, plan)

    def _alike(self, ident: str) -> DataFrame:
        """(root, id, rank) of the symbols most alike to one: one scan."""
        embeddings = self.store.table("embeddings").withColumnRenamed("symbol_id", "id")
        own = embeddings.where(F.col("id") == ident).select("embedding").limit(1).collect()
        near = vectors.neighbours(embeddings, ident, list(own[0].embedding), contexts.SEMANTIC).collect() if own else []
        return self.spark.createDataFrame([(ident, r.id, n) for n, r in enumerate(near, 1)], "root string, id string, rank int")

    def _enriched(self, found: dict, task: contexts.Task, model: Callable[[str], str]) -> dict:
        for key in ("wiki", "flow_wiki"):
            ident = found[f"{key}_page_id"]
            if ident is None or self.store.pages().where((F.col("id") == ident) & prose(F.col("body")).isNull()).isEmpty():
                continue
            self.enrich(ident, model)
            text = for_context(F.col("body"))
            page = self.store.pages().where(F.col("id") == ident).select(text.alias("text"), adds_context(text).alias("adds"), prose(F.col("body")).alias("prose")).first()
            if page.adds:
                found = found | {f"{key}_body": page.text}
                if key == "wiki":
                    found |= {"enriched_summary": page.prose, "summary_source": "mcp_sampling"}
        return contexts.refreshed(found, task)

    # Domains

    def _flow_id(self, name: str) -> str | None:
        known = self.store.table("flows").select("id", "name").unionByName(self.store.table("domains").select("id", "name"))
        found = known.where((F.col("id") == name) | (F.lower("name") == name.lower())).orderBy(F.when(F.col("id") == name, 0).otherwise(1), "id").limit(1).collect()
        return found[0].id if found else None

    def _confirm(self, flow_id: str, name: str) -> None:
        self.store.stage("domains", upsert(self.store.table("domains"), self.spark.createDataFrame([(flow_id, name, "user", True)], DOMAIN), "id"))

    def rename_domain(self, known: str, name: str) -> dict:
        """Gives a domain or flow a name that no other flow has; later builds keep it."""
        flow_id, flows = self._flow_id(known), self.store.table("flows")
        if flow_id is None or flows.where(F.col("id") == flow_id).isEmpty():
            raise NotFound(f"no domain or flow {known}")
        if not flows.where((F.lower("name") == name.lower()) & (F.col("id") != flow_id)).isEmpty():
            raise DomainError(f"the name {name} is in use")
        self.store.stage("flows", flows.withColumn("name", F.when(F.col("id") == flow_id, name).otherwise(F.col("name"))))
        self._confirm(flow_id, name)
        self.store.commit()
        self.write_artifacts()
        return self.flow(name)["flow"]

    def add_to_domain(self, name: str, targets: list[str]) -> dict:
        """Adds paths (with `/` or `*`) or symbols to a domain, made if need be, and rebuilds its flow."""
        if not targets:
            raise DomainError("give at least one path or symbol")
        flow_id = self._flow_id(name) or self.spark.range(1).select(stable_id("flow", F.lit(name))).first()[0]
        rows = [(flow_id, "path" if "/" in t or "*" in t else "symbol", t) for t in targets]
        members = self.store.table("members").unionByName(self.spark.createDataFrame(rows, MEMBER)).distinct()
        domain = self.spark.createDataFrame([(flow_id, name)], "id string, name string")
        built = graph.member_flows(domain, members.where(F.col("domain_id") == flow_id), self.store.table("symbols"), self.store.table("edges"))
        if built.isEmpty():
            raise DomainError(f"no flow for {name}: it needs two symbols or more that call each other")
        self._confirm(flow_id, name)
        self.store.stage("members", members)
        self.store.stage("flows", upsert(self.store.table("flows"), built, "id"))
        self.store.commit()
        self.write_artifacts()
        return self.flow(name)["flow"]


__all__ = ["DomainError", "Engine", "NotBuilt", "NotFound"]
