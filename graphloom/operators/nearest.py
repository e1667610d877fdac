"""Exact k nearest neighbours of many vectors at once: pivots, cells, and bounds by the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pivots; vectors of one piece of a cell, about; queries that are compared with a piece at once.
PIVOTS, PIECE, CHUNK = 64, 8192, 256
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * (x @ y.T), 0))


def _celled(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = _distances(_matrix(batch.column("embedding")), pivots) if batch.num_rows else np.zeros((0, 1))
        cell = d.argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "radius"])


def _sent(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, cells: dict[int, tuple[int, float, float, list[float]]], k: int) -> Iterator[pa.RecordBatch]:
    """Queries, a row for each piece of the cells that may hold one of their k nearest.

    The k + 1 least radii of every cell give bounds from above for as many vectors; the (k + 1)-th least of all these (one may be the query
    itself) bounds the distance that matters. A cell whose nearest or farthest vector lies beyond it is left out."""
    ids = np.array(sorted(cells))
    pieces, low, high = (np.array([cells[c][i] for c in ids.tolist()]) for i in range(3))
    least = np.full((len(ids), k + 1), np.inf)
    for i, c in enumerate(ids.tolist()):
        least[i, : len(cells[c][3])] = cells[c][3]
    for batch in batches:
        if not batch.num_rows:
            continue
        d = _distances(_matrix(batch.column("embedding")), pivots[ids])
        bounds = (d[:, :, None] + least).reshape(len(d), -1)
        limit = np.partition(bounds, k, axis=1)[:, k] if bounds.shape[1] > k else np.full(len(d), np.inf)
        limit = limit * (1 + SLACK) + SLACK
        row, cell = np.nonzero((d - high <= limit[:, None]) & (low - d <= limit[:, None]))
        times = pieces[cell]
        row, cell = np.repeat(row, times), np.repeat(cell, times)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        sent = batch.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(ids[cell].astype(np.int32)), pa.array(piece.astype(np.int32))], names=[*batch.schema.names, "cell", "piece"])


def _best(ids: pa.Array, x: np.ndarray, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The k nearest of x for each query; equal distances in the order of the ids, which are sorted."""
    queries, own = _matrix(asked.column("embedding")), asked.column("id")
    near = _distances(queries, x)
    take = min(k + 1, len(x))
    edge = np.partition(near, take - 1, axis=1)[:, take - 1]
    rows, at = np.nonzero(near <= (edge * (1 + SLACK) + 1e-6)[:, None])
    exact = np.sqrt(((queries[rows] - x[at]) ** 2).sum(axis=1))
    other = pc.not_equal(own.take(pa.array(rows)), ids.take(pa.array(at))).to_numpy(zero_copy_only=False)
    rows, at, exact = rows[other], at[other], exact[other]
    order = np.lexsort((at, exact, rows))
    rows, at, exact = rows[order], at[order], exact[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, at, exact = rows[turn < k], at[turn < k], exact[turn < k]
    return pa.RecordBatch.from_arrays([own.take(pa.array(rows)), ids.take(pa.array(at)), pa.array(exact)], names=["id", "near", "distance"])


def _compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, piece, kind, id): a piece's vectors, which are kept, then its queries, which pass by in chunks."""
    piece, vectors, known = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(name).to_numpy() for name in ("cell", "piece", "kind")]
        change = np.flatnonzero(np.any([k_[1:] != k_[:-1] for k_ in keys], axis=0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            part, here = batch.slice(a, b - a), (keys[0][a], keys[1][a])
            if here != piece:
                piece, vectors, known = here, [], None
            if keys[2][a] == 0:
                vectors.append(part)
            elif vectors:
                if known is None:
                    table = pa.Table.from_batches(vectors)
                    known = table.column("id").combine_chunks(), _matrix(table.column("embedding"))
                for c in range(0, part.num_rows, CHUNK):
                    yield _best(*known, part.slice(c, CHUNK), k)


def nearest_to_each(queries: DataFrame, vectors: DataFrame, k: int, *, pivots: int = PIVOTS, piece: int = PIECE) -> DataFrame:
    """(id, near, distance, rank): for each query (id, embedding) the k nearest other vectors (id, embedding) by L2 distance, ties by id. Exact.

    Each vector goes to the cell of its nearest pivot (a bounded sample); a cell of many vectors, such as copies, is cut into pieces by a hash
    of the id. What the driver knows is a few numbers a cell. Queries go only to cells that can hold one of their neighbours, and pass by a
    piece's vectors in chunks, so a task holds one piece and one chunk. Rows without an id or a vector take no part; vectors have one length."""
    usable = "id is not null and embedding is not null and size(embedding) > 0"
    vectors, queries = vectors.select("id", "embedding").where(usable), queries.select("id", "embedding").where(usable)
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("embedding").collect()
    kind = vectors.schema["id"].dataType.simpleString()
    if not chosen:
        return vectors.select("id", F.col("id").alias("near"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")
    at = np.unique(np.array([r["embedding"] for r in chosen], np.float64), axis=0)
    array = vectors.schema["embedding"].dataType.simpleString()
    celled = vectors.mapInArrow(lambda batches: _celled(batches, at), f"id {kind}, embedding {array}, cell int, radius double")
    radii = celled.withColumn("turn", F.row_number().over(Window.partitionBy("cell").orderBy("radius"))).where(F.col("turn") <= k + 1)
    least = {r["cell"]: sorted(r["least"]) for r in radii.groupBy("cell").agg(F.collect_list("radius").alias("least")).collect()}
    ends = celled.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()
    cells = {r["cell"]: (math.ceil(r["n"] / piece), r["low"], r["high"], least[r["cell"]]) for r in ends}
    pieces = F.element_at(F.create_map(*(F.lit(x) for c, v in cells.items() for x in (c, v[0]))), F.col("cell"))
    objects = celled.select("id", "embedding", "cell", F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece"), F.lit(0).alias("kind"))
    sent = queries.mapInArrow(lambda batches: _sent(batches, at, cells, k), f"id {kind}, embedding {array}, cell int, piece int").withColumn("kind", F.lit(1))
    order = ["cell", "piece", "kind", "id"]
    met = objects.unionByName(sent).repartition("cell", "piece").sortWithinPartitions(*order).mapInArrow(lambda batches: _compared(batches, k), f"id {kind}, near {kind}, distance double")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "near"))).where(F.col("rank") <= k)
