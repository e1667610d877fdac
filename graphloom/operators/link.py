"""Links across repositories by HTTP, RPC and queue contracts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_path, stable_id


def route_ends(rows: DataFrame) -> DataFrame:
    """Ends (repo, symbol, name) of clients or routes (repo, symbol, method, path); the name is the method in capitals and the path."""
    return rows.select("repo", "symbol", F.concat_ws(" ", F.upper("method"), normalize_path(F.col("path"))).alias("name"))


#: Ends of one name in a piece (about), those of the right side that the left ends of a cell meet at a time, and pairs that one task makes (about).
PIECE, TURN, TASK_PAIRS = 1024, 64, 1 << 23


def by_name(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Ends (repo, symbol, name) of one service or topic in different repositories. Other columns of `left` come along.

    There are as many rows as pairs, so pairs are what is dealt out: a name's ends are cut into pieces on both sides, each piece meets each piece
    of the other side in a cell of its own, and the number of tasks follows from the number of pairs. A piece is one row with an array of its ends, also in
    its cells: arrays are what is repeated, moved and joined, and rows are made of them last. A task holds the pieces of its cells and the pairs of one turn.

    Pairs come in an order that a columnar file stores in little: ends lie by repository, and in a turn one left end after the other meets the same few right ends."""
    a = left.withColumnsRenamed({"repo": "src_repo", "symbol": "src"})
    b = right.select(F.col("repo").alias("dst_repo"), F.col("symbol").alias("dst"), name)
    counted = lambda ends, of: ends.groupBy(name).agg(F.count("*").alias(of))
    sizes = counted(a, "lefts").join(counted(b, "rights"), name)
    pairs = sizes.agg(F.sum(F.col("lefts").cast("double") * F.col("rights"))).first()[0] or 0
    sizes = sizes.select(name, *(F.ceil(F.col(n) / PIECE).cast("int").alias(n) for n in ("lefts", "rights")))
    cell, tasks = [name, "left_piece", "right_piece"], max(1, math.ceil(pairs / TASK_PAIRS))

    def pieces(ends: DataFrame, own: str, mine: str, other: str, others: str) -> DataFrame:
        columns = [c for c in ends.columns if c != name]
        by = [c for c in columns if c in ("src_repo", "src", "dst_repo", "dst")]
        dealt = ends.join(sizes, name).withColumn(own, F.pmod(F.xxhash64(*by), F.col(mine)).cast("int")).repartition(name, own).sortWithinPartitions(name, own, *by)
        held = dealt.groupBy(name, own, others).agg(F.collect_list(F.struct(*columns)).alias(f"{own}_ends"))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select(*cell, f"{own}_ends").repartition(tasks, *cell)

    lefts, rights = pieces(a, "left_piece", "lefts", "right_piece", "rights"), pieces(b, "right_piece", "rights", "left_piece", "lefts")
    # Spark holds all rows that it makes of one row in a stage without a sort, so turns are sorted: what is held are the pairs of a turn, not of a cell.
    turns = rights.select(*cell, F.posexplode(F.expr(f"transform(sequence(1, size(right_piece_ends), {TURN}), at -> slice(right_piece_ends, at, {TURN}))")).alias("turn", "turn_ends"))
    met = turns.sortWithinPartitions(*cell, "turn").join(lefts.hint("merge"), cell).select(name, F.inline("left_piece_ends"), "turn_ends")
    return met.select("*", F.inline("turn_ends")).drop("turn_ends").where("src_repo <> dst_repo")


def by_contract(contracts: DataFrame, servers: DataFrame, clients: DataFrame, first_symbol: DataFrame) -> DataFrame:
    """contracts (name, src_repo, dst_repo) with the first matching server, and the first matching client or else the first symbol of its repository."""
    s = servers.groupBy(F.col("repo").alias("dst_repo"), "name").agg(F.min("symbol").alias("dst"))
    c = clients.groupBy(F.col("repo").alias("src_repo"), "name").agg(F.min("symbol").alias("client"))
    f = first_symbol.groupBy(F.col("repo").alias("src_repo")).agg(F.min("symbol").alias("fallback"))
    out = contracts.join(s, ["dst_repo", "name"]).join(c, ["src_repo", "name"], "left").join(f, "src_repo", "left")
    return out.select("src_repo", F.coalesce("client", "fallback").alias("src"), "dst_repo", "dst", "name")


def first_writer(passes: list[DataFrame]) -> DataFrame:
    """The union of edge tables (id, ...); of equal ids the row of the earliest pass stays. `pass` is its number."""
    columns = [c for c in passes[0].columns if c != "id"]
    all_ = reduce(lambda a, b: a.unionByName(b), [p.withColumn("pass", F.lit(i)) for i, p in enumerate(passes)])
    return all_.groupBy("id").agg(F.min_by(F.struct(*columns), "pass").alias("e"), F.min("pass").alias("pass")).select("id", "e.*", "pass")


def cross_edge_id(kind: str) -> F.Column:
    return stable_id("cross_edge", F.col("src_repo"), F.col("src"), F.col("dst_repo"), F.col("dst"), kind)
