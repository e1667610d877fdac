"""Several trees as one workspace: a manifest, a build of each tree, and edges across them."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.text import normalize_path
from .operators import link
from .operators.resolve import enclosing
from .sources import parse
from .sources.store import Store, qualified, read_text

MANIFEST = "graphloom.workspace.toml"
# What edges of each kind cross, and how sure a found, a shared and a declared edge are.
BOUNDARY = {"http": "network", "grpc": "network", "queue": "queue", "shared_lib": "shared_lib"}
FOUND, SHARED, DECLARED = 0.85, 0.9, 1.0
EDGE = ("id", "src_repo", "src_symbol_id", "dst_repo", "dst_symbol_id", "edge_type", "boundary", "confidence", "label")
JSON = {"src_repo": "srcRepo", "src_symbol_id": "srcSymbolId", "dst_repo": "dstRepo", "dst_symbol_id": "dstSymbolId", "edge_type": "edgeType"}
CONTRACT = {"http": ("client_repo", "server_repo", "method", "path"), "grpc": ("client_repo", "server_repo", "service"), "queue": ("producer_repo", "consumer_repo", "topic"), "shared_lib": ("package", "repos")}


@dataclass
class Manifest:
    name: str
    repos: dict[str, str]
    contracts: dict[str, list[dict]] = field(default_factory=dict)


def manifest(text: str) -> Manifest:
    """ValueError if it isn't TOML or lacks a name, or if a repository or a contract lacks a field."""
    raw = tomllib.loads(text)
    try:
        repos = {r["name"]: r["path"] for r in raw.get("repos", [])}
        contracts = {kind: [{f: c[f] for f in fields} for c in raw.get("contracts", {}).get(kind, [])] for kind, fields in CONTRACT.items()}
        return Manifest(raw["name"], repos, contracts)
    except (KeyError, TypeError) as missing:
        raise ValueError(f"the manifest lacks {missing}") from missing


def discover(spark: SparkSession, folder: str) -> str | None:
    """The nearest folder, from this one upwards, that has a manifest."""
    scheme, _, path = qualified(spark, folder).partition(":")
    for at in (PurePosixPath(path), *PurePosixPath(path).parents):
        if read_text(spark, f"{scheme}:{at}/{MANIFEST}") is not None:
            return f"{scheme}:{at}"
    return None


def _edges(pairs: DataFrame, kind: str, confidence: float, label: Column) -> DataFrame:
    """Edges from pairs (src_repo, src, dst_repo, dst, ...)."""
    kept = pairs.where("src is not null and dst is not null")
    named = kept.select(link.cross_edge_id(kind).alias("id"), "src_repo", F.col("src").alias("src_symbol_id"), "dst_repo", F.col("dst").alias("dst_symbol_id"), F.lit("imports" if kind == "shared_lib" else kind).alias("edge_type"), F.lit(BOUNDARY[kind]).alias("boundary"), F.lit(confidence).cast("float").alias("confidence"), label.alias("label"))
    return named.groupBy("id").agg(F.min(F.struct(*EDGE[1:])).alias("e")).select("id", "e.*")


def cross_edges(spark: SparkSession, plan: Manifest, symbols: DataFrame, routes: DataFrame, clients: DataFrame, signals: DataFrame, imports: DataFrame) -> DataFrame:
    """One row an edge id, of its earliest pass. Passes: HTTP, RPC, queues, shared packages, each as found and then as declared.

    symbols (repo, id, name, file_path, start_line), routes and clients (repo, symbol, method, path), signals (repo, symbol,
    kind, name), imports (repo, file_path, name).
    """
    place = F.struct("file_path", "start_line", "id")
    first = symbols.groupBy("repo").agg(F.min_by("id", place).alias("symbol"))
    side = lambda kind: signals.where(F.col("kind") == kind).select("repo", "symbol", "name")
    sides = {"http": (link.route_ends(clients), link.route_ends(routes)), "grpc": (side("rpc_client"), side("rpc_server")), "queue": (side("producer"), side("consumer"))}
    passes = []
    for kind, (callers, servers) in sides.items():
        passes.append(_edges(link.by_name(callers, servers, "name"), kind, FOUND, F.col("name")))
        if declared := plan.contracts.get(kind):
            passes.append(_declared(spark, kind, declared, callers, servers, first))
    if shared := plan.contracts.get("shared_lib"):
        passes += shared_edges(spark, shared, symbols, imports, first)
    return link.first_writer(passes).drop("pass").orderBy("src_repo", "src_symbol_id", "dst_repo", "dst_symbol_id")


def _declared(spark: SparkSession, kind: str, declared: list[dict], callers: DataFrame, servers: DataFrame, first: DataFrame) -> DataFrame:
    """Edges of contracts. A caller that isn't found is the first symbol of its repository; a consumer of a queue likewise."""
    rows = spark.createDataFrame([tuple(c.values()) for c in declared], ", ".join(f"{f} string" for f in CONTRACT[kind]))
    if kind == "http":
        name = F.concat_ws(" ", F.upper("method"), normalize_path(F.col("path")))
    else:
        name = F.col("service" if kind == "grpc" else "topic")
    src, dst = CONTRACT[kind][:2]
    contracts = rows.select(F.col(src).alias("src_repo"), F.col(dst).alias("dst_repo"), name.alias("name"))
    if kind == "queue":
        servers = servers.unionByName(contracts.join(first.withColumnRenamed("repo", "dst_repo"), "dst_repo").select(F.col("dst_repo").alias("repo"), "symbol", "name").join(servers, ["repo", "name"], "left_anti"))
    return _edges(link.by_contract(contracts, servers, callers, first), kind, DECLARED, F.col("name"))


def shared_edges(spark: SparkSession, shared: list[dict], symbols: DataFrame, imports: DataFrame, first: DataFrame) -> list[DataFrame]:
    """Edges from users of a declared package to the symbol of its name elsewhere: from importers, and between the named repositories."""
    place = F.struct("file_path", "start_line", "id")
    packages = spark.createDataFrame([(c["package"],) for c in shared], "package string").distinct()
    owners = symbols.join(packages, F.col("name") == F.col("package")).groupBy("package", F.col("repo").alias("dst_repo")).agg(F.min_by("id", place).alias("dst"))
    users = imports.join(packages, F.col("name") == F.col("package")).select("repo", "package", "file_path").distinct()
    inside = users.join(symbols, ["repo", "file_path"]).groupBy("repo", "package").agg(F.min_by("id", place).alias("near"))
    importers = users.select("repo", "package").distinct().join(inside, ["repo", "package"], "left").join(first, "repo").select(F.col("repo").alias("src_repo"), "package", F.coalesce("near", "symbol").alias("src"))
    found = importers.join(owners, "package").where("src_repo <> dst_repo")
    named = spark.createDataFrame([(c["package"], r) for c in shared for r in c["repos"]], "package string, repo string").distinct()
    sources = named.join(first, "repo").select("package", F.col("repo").alias("src_repo"), F.col("symbol").alias("src"))
    targets = owners.join(named.withColumnRenamed("repo", "dst_repo"), ["package", "dst_repo"])
    return [_edges(found, "shared_lib", SHARED, F.col("package")), _edges(sources.join(targets, "package").where("src_repo <> dst_repo"), "shared_lib", DECLARED, F.col("package"))]


class Workspace:
    """A folder with a manifest; its repositories are few, their files need not be."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        text = read_text(spark, f"{qualified(spark, folder)}/{MANIFEST}")
        if text is None:
            raise FileNotFoundError(f"no {MANIFEST} in {folder}")
        self.spark, self.store, self.manifest = spark, Store(spark, folder), manifest(text)
        self.members = {name: Engine(spark, f"{self.store.root}/{path}") for name, path in self.manifest.repos.items()}

    def _all(self, frame) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [frame(e).withColumn("repo", F.lit(name)) for name, e in self.members.items()])

    def build(self, incremental: bool = True) -> dict[str, int]:
        """Builds every member, then links them; cross_repo.json holds the edges."""
        for engine in self.members.values():
            engine.build(incremental)
        table = lambda name: self._all(lambda e: e.store.table(name))
        symbols, parsed = table("symbols"), table("parsed")
        scopes = symbols.groupBy("repo", F.col("file_path").alias("path"), F.col("name").alias("scope")).agg(F.min_by("id", F.struct("start_line", "id")).alias("symbol"))
        clients = parsed.select("repo", "path", F.inline("clients").alias("scope", "method", "url")).join(scopes, ["repo", "path", "scope"]).select("repo", "symbol", "method", F.col("url").alias("path"))
        label = F.split(F.trim("label"), r"\s+")
        routes = table("entrypoints").where((F.col("kind") == "http") & (F.size(label) >= 2)).select("repo", F.col("symbol_id").alias("symbol"), label[0].alias("method"), label[1].alias("path"))
        lines = table("files")
        signals = parse.signals(lines.select(F.concat_ws("\0", "repo", "path").alias("path"), "text"))
        known = symbols.select(F.concat_ws("\0", "repo", "file_path").alias("file"), "id", "start_line", "end_line")
        at = enclosing(signals.select(F.col("path").alias("file"), "line").distinct(), known).withColumnRenamed("file", "path")
        signals = signals.join(at, ["path", "line"]).select(F.split("path", "\0")[0].alias("repo"), F.regexp_replace("symbol", "^unknown:[^\0]*\0", "unknown:").alias("symbol"), "kind", "name")
        imports = parsed.select("repo", F.col("path").alias("file_path"), F.explode("imports").alias("name"))
        edges = self.store.stage("cross_edges", cross_edges(self.spark, self.manifest, symbols, routes, clients, signals, imports))
        self.store.commit()
        renamed = edges.orderBy("src_repo", "src_symbol_id", "dst_repo", "dst_symbol_id", "id").select(*(F.col(c).alias(JSON.get(c, c)) for c in EDGE))
        self.store.write_artifact("cross_repo", {"edges": renamed}, {"workspace": self.manifest.name})
        return {"repos": len(self.members), "cross_edges": edges.count()}

    def cross_edges(self) -> DataFrame:
        return self.store.table("cross_edges")
