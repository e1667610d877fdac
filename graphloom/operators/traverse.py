"""Bounded reachability, impact, and breadth-first order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .sets import PART, PIECE, counted, expanded, united

#: Each level reads the one before twice; the plan is cut that often.
CUT_EVERY = 4
#: Roots that walk in rows.
FEW = 64
#: Nodes that the roots of a block take over in two steps (about, by the mean of successors).
BLOCK_NODES = 1 << 22


def _many(roots: DataFrame) -> bool:
    return roots.limit(FEW + 1).count() > FEW


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes on a walk of 1..max(depth, 1) edges from each root, with the least number of edges.

    The root itself is there only if a cycle leads back to it. A node goes into a root's frontier once, so the work is bounded by the
    edges met, not by the number of walks. More than FEW roots walk together in sets, fewer in rows, which need no sets of all nodes' successors.
    """
    roots = roots.select("root")
    if _many(roots):
        return reach_sets(edges, roots, depth).select("root", F.explode("nodes").alias("node"), "depth")
    frontier, seen = roots.select("root", F.col("root").alias("node")), None
    for level in range(1, max(depth, 1) + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen, ["root", "node"], "left_anti")
        step = step.withColumn("depth", F.lit(level))
        if level % CUT_EVERY == 0:
            step = materialized(step)
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select("root", "node")
    return seen


def reach_sets(edges: DataFrame, roots: DataFrame, depth: int, tags: DataFrame | None = None) -> DataFrame:
    """(root, part, depth, nodes): the nodes of each root by their least number of edges, in sets. With tags (node, tag) of numbers it is (root, depth, tag, n, least):
    the number of nodes of a tag (-1: of none) in a set, and the least of them, so that what is asked of a node needs no row for each root that reaches it.

    What moves are sets, not rows of one node, and not a set for each root that goes on: roots are dealt to blocks by ranges, the successors of a node are
    arrays of up to PIECE and move once to each block that has a root there, and roots take them over and unite them in their block, in passes over sorted rows. Where roots that
    lie together reach the same nodes, that is far less than an array for each root and node, and elsewhere it is not more. In graphs of more than PART nodes, nodes are dealt to
    parts, and a root has a set of its own in each, so that no task ever holds more than about PART nodes of one root. A node goes into a
    frontier once, so the work is bounded by the edges met, not by the number of walks. Edges that are dealt by src already are not moved to find their pieces."""
    links, lists = edges.select("src", "dst").where("src is not null and dst is not null"), ["nodes"]
    if tags is not None:
        links = links.join(tags.select(F.col("node").alias("dst"), "tag"), "dst", "left").withColumn("tag", F.coalesce("tag", F.lit(-1).cast(tags.schema["tag"].dataType)))
        links, lists = links.repartition("src"), [*lists, "tags"]
    near = materialized(_pieces(links.distinct(), F.lit(0)))
    each = near.select("src", F.explode("nodes").alias("dst"))
    n, sources, known = each.agg(F.count("*"), F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first()
    parts, blocks = math.ceil((known or 1) / PART), math.ceil((n * n / max(sources, 1) or 1) / BLOCK_NODES)
    if parts > 1:
        rows = near.select("src", F.inline(F.arrays_zip(*lists))).withColumnsRenamed({"nodes": "dst", "tags": "tag"})
        near = materialized(_pieces(rows, F.pmod(F.xxhash64("dst"), F.lit(parts)).cast("int")))
    roots = roots.select("root").distinct()
    # Fixed by the checkpoint: the number of a range is not the same if it's found again.
    roots = materialized(roots.repartitionByRange(blocks, "root").withColumn("block", F.spark_partition_id()))
    columns = ["block", "root", "part", "depth", *lists]
    state = roots.join(near, roots["root"] == near["src"]).withColumn("depth", F.lit(1)).select(*columns).repartition(blocks, "block")
    last = max(depth, 1)
    for level in range(2, last + 1):
        met = _met(state, near, level, blocks, lists)
        if level == last and tags is not None:
            # Counted in the pass that unites them, sets don't go through rows again.
            return _counted(state).unionByName(_counted(met, lambda batches: united(batches, last)))
        step = met.mapInArrow(lambda batches, level=level: united(batches, level), met.schema)
        if level % CUT_EVERY == 0:
            step = materialized(step)
        state = state.unionByName(step)
    return state.select("root", "part", "depth", "nodes") if tags is None else _counted(state)


def _pieces(links: DataFrame, part: F.Column) -> DataFrame:
    """(src, part, nodes and maybe tags): the successors of each src and part, in order, in arrays of up to PIECE; from different rows (src, dst and maybe tag)."""
    turn = F.row_number().over(Window.partitionBy("src").orderBy("part", "dst"))
    lists = [F.collect_list(c).alias(of) for c, of in (("dst", "nodes"), ("tag", "tags")) if c in links.columns]
    return links.withColumn("part", part).withColumn("piece", F.floor(turn / PIECE)).groupBy("src", "part", "piece").agg(*lists).drop("piece")


def _met(state: DataFrame, near: DataFrame, level: int, blocks: int, lists: list[str]) -> DataFrame:
    """The sets of all roots and, at this level, the successors of those nodes that they had at the level before, sorted by root and part."""
    kinds, before = {f.name: f.dataType for f in state.schema}, F.col("depth") == level - 1
    kind, none = kinds["nodes"].elementType, lambda c: F.lit(None).cast(kinds[c])
    asked = state.where(before).select("block", F.explode("nodes").alias("node")).distinct()
    found = asked.join(near, asked["node"] == near["src"]).select("block", none("root").alias("root"), "node", "part", none("depth").alias("depth"), *lists)
    rows = found.unionByName(state.withColumn("node", F.lit(None).cast(kind))).repartition(blocks, "block")
    # Roots go on from their nodes as rows only where they are united.
    own = F.struct("node", "part", "depth", *lists)
    on = F.transform("nodes", lambda x: F.struct(x.alias("node"), *(none(c).alias(c) for c in ("part", "depth", *lists))))
    rows = rows.select("block", "root", F.inline(F.when(F.col("root").isNotNull() & before, F.concat(F.array(own), on)).otherwise(F.array(own))))
    met = rows.sortWithinPartitions("block", "node", "root").mapInArrow(lambda batches: expanded(batches, level), rows.drop("node").schema)
    return met.sortWithinPartitions("root", "part")


def _counted(sets: DataFrame, before: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    root, tag, node = (sets.schema["root"].dataType, *(sets.schema[c].dataType.elementType for c in ("tags", "nodes")))
    schema = f"root {root.simpleString()}, depth int, tag {tag.simpleString()}, n bigint, least {node.simpleString()}"
    return sets.mapInArrow(lambda batches: counted(before(batches)), schema)


#: Fixed value: more affected symbols than this are a risk.
RISK = 10
#: Kinds of nodes that are numbered in one task and go to every task, at most.
BROADCAST = 1 << 14


def impact(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """One row per root: affected and tests (long): how many nodes it reaches, and how many of them lie in test paths; risk: whether affected
    is many; modules: the directories of the nodes known to `nodes` (id, module, path) in order of first appearance (by depth, then id).

    Only counts and the modules' first places are gathered, never a root's nodes. Of many roots the sets carry a number for the module of each node, so they are
    counted as they are, without a row or a join for a root's node."""
    test, levels = F.col("path").contains("test") | F.col("path").contains("spec"), range(1, max(depth, 1) + 1)
    known = nodes.select("id", "module", test.alias("test"))
    if _many(roots):
        kinds = materialized(known.select("module", "test").distinct())
        if kinds.count() <= BROADCAST:
            kinds = F.broadcast(kinds.withColumn("tag", F.row_number().over(Window.orderBy("module", "test")).cast("short")))
        else:
            kinds = materialized(kinds.withColumn("tag", F.monotonically_increasing_id()))
        tags = known.join(kinds.withColumnsRenamed({"module": "m", "test": "t"}), F.col("module").eqNullSafe(F.col("m")) & F.col("test").eqNullSafe(F.col("t"))).select(F.col("id").alias("node"), "tag")
        met = reach_sets(edges, roots, depth, tags).join(kinds, "tag", "left")
    else:
        met = reachable(edges, roots, depth).join(known, F.col("node") == F.col("id"), "left").select("root", "depth", "module", "test", F.lit(1).alias("n"), F.col("node").alias("least"))
    # The least node of each depth by itself: a minimum of structs would have all rows sorted.
    least = [F.min(F.when(F.col("depth") == k, F.col("least"))).alias(f"least{k}") for k in levels]
    first = met.groupBy("root", "module").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("test"), F.col("n")).otherwise(0)).alias("t"), *least)
    at = F.coalesce(*(F.when(F.col(f"least{k}").isNotNull(), F.struct(F.lit(k).alias("depth"), F.col(f"least{k}").alias("node"))) for k in levels))
    named = F.when(F.col("module") != "", F.struct(at.alias("at"), "module"))
    rows = first.groupBy("root").agg(F.sum("n").alias("affected"), F.sum("t").alias("tests"), F.sort_array(F.collect_list(named)).alias("m"))
    out = roots.join(rows, "root", "left")
    zero = F.lit(0).cast("long")
    modules = F.coalesce(F.transform("m", lambda x: x["module"]), F.array().cast("array<string>"))
    return out.select("root", F.coalesce("affected", zero).alias("affected"), F.coalesce("tests", zero).alias("tests"), (F.coalesce("affected", zero) > RISK).alias("risk"), modules.alias("modules"))


#: Rows of one place where the different neighbours are found (about).
ROWS_A_PLACE = 1 << 19


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, side, other): callers and callees by call edges.

    Edges are read once, as a row for either end. They are dealt to so many places that one's rows don't grow with the edges."""
    links = materialized(edges.select("src", "dst"))
    end = lambda node, calls, other: F.struct(F.col(node).alias("node"), F.lit(calls).alias("calls"), F.col(other).alias("other"))
    ends = F.array(end("dst", True, "src"), end("src", False, "dst"))
    met = links.select(F.inline(ends)).join(nodes.select("node"), "node", "left_semi")
    met = met.repartition(1 + 2 * links.count() // ROWS_A_PLACE, "node", "calls", "other").distinct()
    return met.select("node", F.when(F.col("calls"), "caller").otherwise("callee").alias("side"), "other")


#: Edges of a breadth-first walk that lie together (about).
EDGES_A_PLACE = 1 << 16


def breadth_first(edges: DataFrame, roots: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(root, node, position): the order of a queue that takes neighbours by id; positions from 1, the root first.

    Roots may have a column `start`, the first node of a walk whose root is but a name. `allowed` (root, node) restricts the walk. Nodes of a level stand in the order of their first parent, then of their id.

    Edges are cut down to what the walk may take and dealt by their source once; only frontiers move from level to level, dealt alike. What has been seen stays where it
    is, in runs of about doubling size, so a node is written again only a logarithmic number of times.
    """
    inside, by = edges.select("src", "dst"), ["src"]
    if allowed is not None:
        ends, by = allowed.select("root", "node").distinct(), ["root", "src"]
        inside = inside.join(ends.withColumnRenamed("node", "src"), "src").join(ends.withColumnRenamed("node", "dst"), ["root", "dst"], "left_semi")
    inside = materialized(inside.distinct())
    places = 1 + inside.count() // EDGES_A_PLACE
    inside = materialized(inside.repartition(places, *by))
    dealt = lambda rows: materialized(rows.repartition(places, "root", "node"))
    start = "start" if "start" in roots.columns else "root"
    frontier = dealt(roots.select("root", F.col(start).alias("node"), F.lit(1).cast("long").alias("position")))
    runs: list[tuple[int, DataFrame]] = []
    while size := frontier.count():
        runs.append((size, frontier))
        while len(runs) > 1 and runs[-2][0] <= 2 * runs[-1][0]:
            (n, last), (m, before) = runs.pop(), runs.pop()
            runs.append((m + n, dealt(before.unionByName(last))))
        met = frontier.withColumnRenamed("node", "src").join(inside, by).select(frontier["root"], F.col("dst").alias("node"), "position")
        step = met.repartition(places, "root", "node").groupBy("root", "node").agg(F.min("position").alias("parent"))
        for _, seen in runs:
            step = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        # The last position of a root that goes on is one of its frontier.
        base = frontier.groupBy("root").agg(F.max("position").alias("base"))
        order = Window.partitionBy("root").orderBy("parent", "node")
        frontier = dealt(step.join(base, "root").select("root", "node", (F.col("base") + F.row_number().over(order)).alias("position")))
    return reduce(DataFrame.unionByName, [seen for _, seen in runs]) if runs else frontier
