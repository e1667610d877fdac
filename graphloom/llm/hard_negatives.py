"""Hard-negative mining: vantage-point trees over norm-augmented vectors, windows of scores as annuli of distance.

A vector x becomes (x, sqrt(M - |x|**2)), M the largest squared norm of all; an anchor a becomes (a, 0). Then |a - x|**2 = |a|**2 + M -
2 a.x: the nearest are those with the largest inner product, and a window of scores is an annulus around the anchor.

1. Index. A small tree over a bounded sample (`SAMPLE` vectors) deals all rows out to shards of vectors that lie together; a shard with
   many rows (copies lie together too) is cut in pieces by a hash of the id. Each piece, some `SHARD` rows, becomes one row of a written
   table: ids, labels, vectors and its own vantage-point tree, whose nodes keep the least and largest distance of their rows from the
   vantage point of the node above.
2. Search. Anchors are taken in blocks of about ANCHORS, which are broadcast. A task goes through the pieces of its partition, nearest
   node first: a node whose annulus misses the window, or whose best possible score is below the worst of the k rows found so far, is
   left out with all its rows. The task returns k rows an anchor, so what is shuffled grows with the anchors, not with anchors times pieces.
   First the positives (k rows of the anchor's label), then for each positive the negatives inside its window.

Bounds are computed in floating point with some slack, scores as exact integers; all rows are indexed and nothing is approximate.

Edges: rows without id, label or vector, or with a null component, take no part; of rows with equal ids the least (label, vector) does;
shorter vectors count as padded with zeros; ties go by smaller id; an anchor without positives, or a positive whose window is empty (as
every window of a negative score is), returns no rows; tables without rows or anchors give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, saved, table

SAMPLE = 4096
SHARD = 16384
LEAF = 256
#: Anchors of one block, about: 64 numbers of 4 bytes each make 4 MB.
ANCHORS = 16384
SLACK = 1e-6


@dataclass
class Tree:
    """Nodes as arrays. Of node i: rows low[i]..high[i]-1; the vantage point of its parent and the least and largest distance of the
    node's rows from it; its children, or -1 for a leaf; the place of its own vantage point among the rows."""

    low: np.ndarray
    high: np.ndarray
    near: np.ndarray
    far: np.ndarray
    left: np.ndarray
    right: np.ndarray
    point: np.ndarray

    NAMES = ("low", "high", "near", "far", "left", "right", "point")


def grow(x: np.ndarray, leaf: int) -> tuple[np.ndarray, Tree]:
    """The order of the rows (augmented vectors) along a vantage-point tree, and the tree."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0, 0.0, np.inf)]
    while todo:
        low, high, parent, side, near, far = todo.pop()
        at = len(nodes)
        nodes.append([low, high, near, far, -1, -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = at
        if high - low <= leaf:
            continue
        # The vantage point: the row that lies farthest from the first.
        here = x[order[low:high]]
        point = order[low + int(np.argmax(((here - here[0]) ** 2).sum(axis=1)))]
        away = np.sqrt(((here - x[point]) ** 2).sum(axis=1))
        middle = (high - low) // 2
        split = np.argpartition(away, middle)
        if away.min() == away.max():
            continue
        order[low:high], away = order[low:high][split], away[split]
        nodes[at][6] = point
        for side, (a, b) in enumerate(((0, middle), (middle, high - low))):
            todo.append((low + a, low + b, at, side, float(away[a:b].min()), float(away[a:b].max())))
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    tree = Tree(*(c.astype(np.float64 if i in (2, 3) else np.int64) for i, c in enumerate(columns)))
    tree.point = np.where(tree.point >= 0, place[tree.point], -1)
    return order, tree


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def _padded(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Piece:
    """Rows of one shard with their tree, and the distances of a block of anchors from its vantage points."""

    def __init__(self, row: dict, width: int, most: float, anchors: np.ndarray, norms: np.ndarray):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.int64).reshape(len(self.ids), width).astype(np.float64)
        self.tree = Tree(*(np.frombuffer(row[name], np.float64 if name in ("near", "far") else np.int64) for name in Tree.NAMES))
        self.inner = np.flatnonzero(self.tree.point >= 0)
        self.column = np.full(len(self.tree.low), -1)
        self.column[self.inner] = np.arange(len(self.inner))
        self.anchors, self.norms, self.most = anchors, norms, most
        products = anchors @ self.x[self.tree.point[self.inner]].T
        self.distance = np.sqrt(np.maximum(norms[:, None] + most - 2 * products, 0))

    def nearest(self, a: int, low: float, high: float, least) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of the rows with low <= score <= high, leaf by leaf, the leaf with the least distance first. least():
        the score below which nothing is wanted any more."""
        tree, heap = self.tree, [(0.0, 0)]
        base = self.norms[a] + self.most
        outer = math.sqrt(max(base - 2 * low, 0.0)) * (1 + SLACK) + SLACK if low > -math.inf else math.inf
        inner = math.sqrt(max(base - 2 * high, 0.0)) * (1 - SLACK) - SLACK if high < math.inf else 0.0
        while heap:
            bound, node = heapq.heappop(heap)
            wanted = least()
            if bound > outer or wanted > -math.inf and bound > math.sqrt(max(base - 2 * wanted, 0.0)) * (1 + SLACK) + SLACK:
                return
            if self.column[node] < 0:
                rows = slice(tree.low[node], tree.high[node])
                scores = self.x[rows] @ self.anchors[a]
                met = np.flatnonzero((scores >= low) & (scores <= high))
                yield met + tree.low[node], scores[met]
                continue
            d = self.distance[a, self.column[node]]
            for child in (tree.left[node], tree.right[node]):
                nearest = max(bound, d - tree.far[child], tree.near[child] - d)
                if nearest <= outer and d + tree.far[child] >= inner:
                    heapq.heappush(heap, (nearest, child))


class Best:
    """The first k rows found so far: larger scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least()
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


def _indexed(group: pa.Table, width: int, most: float, leaf: int) -> pa.Table:
    vectors = _padded(group.column("vector").to_pylist(), width)
    order, tree = grow(_augmented(vectors, most), leaf)
    blobs = {"ids": group.column("id").to_numpy()[order].astype(np.int64), "labels": group.column("label").to_numpy()[order].astype(np.int64), "vectors": vectors[order]}
    blobs |= {name: getattr(tree, name) for name in Tree.NAMES}
    return pa.table({name: pa.array([x.tobytes()], pa.binary()) for name, x in blobs.items()})


BLOBS = ", ".join(f"{name} binary" for name in ("ids", "labels", "vectors", *Tree.NAMES))


def index(rows: DataFrame, width: int, most: float, *, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """The written table of pieces of a written table (id, label, vector)."""
    count = rows.count()
    sample = _padded([r["vector"] for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").collect()], width)
    x = _augmented(sample, most)
    order, tree = grow(x, max(1, SAMPLE * shard // max(count, shard)))
    x = x[order]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Down the small tree: to the half whose distances from the vantage point are the closer ones."""
        for batch in batches:
            own = _augmented(_padded(batch.column("vector").to_pylist(), width), most)
            at = np.zeros(len(own), np.int64)
            while len(moving := np.flatnonzero(tree.point[at] >= 0)):
                node = at[moving]
                d = np.sqrt(((own[moving] - x[tree.point[node]]) ** 2).sum(axis=1))
                middle = (tree.far[tree.left[node]] + tree.near[tree.right[node]]) / 2
                at[moving] = np.where(d <= middle, tree.left[node], tree.right[node])
            yield batch.append_column("shard", pa.array(at, pa.int64()))

    placed = saved(rows.mapInArrow(dealt, "id long, label long, vector array<long>, shard long"))
    parts = placed.groupBy("shard").agg(F.ceil(F.count("*") / shard).alias("pieces"))  # as many rows as the small tree has leaves
    cut = placed.join(F.broadcast(parts), "shard").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces")).drop("pieces")
    out = saved(cut.groupBy("shard", "piece").applyInArrow(lambda group: _indexed(group, width, most, leaf), BLOBS))
    release(placed)
    return out


def _search(pieces: DataFrame, width: int, most: float, wanted, k: int, same: bool) -> DataFrame:
    """(anchor, query, id, score): up to k rows a query and task. wanted: a broadcast of (anchor ids, labels, vectors, queries), a query being
    (its number, place of the anchor, least score, largest score); rows have the anchor's label if same, else another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, queries = wanted.value
        anchors = vectors.astype(np.float64)
        norms = (anchors**2).sum(axis=1)
        best = [Best(k) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                piece = Piece(row, width, most, anchors, norms)
                for q, (_, a, low, high) in enumerate(queries):
                    for places, scores in piece.nearest(a, low, high, best[q].least):
                        fits = (piece.labels[places] == labels[a]) & (piece.ids[places] != ids[a]) if same else piece.labels[places] != labels[a]
                        best[q].add(scores[fits], piece.ids[places[fits]])
        number = np.repeat([q[0] for q in queries], [len(b.ids) for b in best]).astype(np.int64)
        found, scores = (np.concatenate([np.zeros(0, np.int64), *(getattr(b, name) for b in best)]).astype(np.int64) for name in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(found), pa.array(scores)], names=["query", "id", "score"])

    tasks = pieces.sparkSession.sparkContext.defaultParallelism
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    met = pieces.coalesce(tasks).mapInArrow(run, "query long, id long, score long")
    return met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_anchors: int = ANCHORS, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id long, rank int, negative_id, positive_score, negative_score long).

    rows: (id long, label long, vector array<long>); anchors: ids of rows (column id). A positive's negatives have scores of low to high
    percent of its own. Components must be small enough for inner products below 2**53."""
    spark = rows.sparkSession
    usable = rows.where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = saved(usable.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector"))
    width, most = rows.agg(F.max(F.size("vector")), F.max(F.expr("aggregate(vector, 0L, (s, x) -> s + x * x)"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if most is None:
        return spark.createDataFrame([], schema)
    pieces = index(rows, width, float(most), shard=shard, leaf=leaf)
    chosen = saved(rows.join(anchors.select("id").distinct(), "id", "left_semi"))
    release(rows)
    blocks, out = max(1, math.ceil(chosen.count() / block_anchors)), None
    for block in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()
        if not own:
            continue
        ids, labels = (np.array([r[name] for r in own], np.int64) for name in ("id", "label"))
        vectors = _padded([r["vector"] for r in own], width)
        ask = lambda queries: spark.sparkContext.broadcast((ids, labels, vectors, queries))  # noqa: B023, E731
        one = ask([(a, a, -math.inf, math.inf) for a in range(len(ids))])
        met = [tuple(r) for r in _search(pieces, width, float(most), one, positives, True).select("query", "id", "score").collect()]
        one.destroy()
        windows = [(n, a, math.ceil(low * s / 100), math.floor(high * s / 100)) for n, (a, _, s) in enumerate(met) if low * s <= high * s]
        two = ask(windows)
        pairs = spark.createDataFrame([(n, int(ids[a]), i, s) for n, (a, i, s) in enumerate(met)], "query long, anchor_id long, positive_id long, positive_score long")
        found = saved(_search(pieces, width, float(most), two, negatives, False).join(F.broadcast(pairs), "query").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        two.destroy()
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end").cast("long")
    rows = e.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.expr("transform(embedding, x -> floor(256 * double(x)))").alias("vector"))
    return hard_negatives(rows, rows.where("id % 100 = 0").select("id"))
