"""The k nearest of each query against all distances: copies, ties, many cells and pieces."""

import numpy as np
import pytest

from graphloom.operators.nearest import _sent, nearest_to_each


def plain(rows, asked, k):
    out = []
    for i in asked:
        own = next(v for j, v in rows if j == i)
        near = sorted((round(float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())), 6), j) for j, v in rows if j != i)
        out += [(i, j, d, n) for n, (d, j) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("pivots", "piece"), [(64, 8192), (5, 7)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_equals_all_distances(spark, pivots, piece, kind):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 10, (6, 4))
    name = (lambda n: f"s{n:04}") if kind == "string" else int
    rows = [(name(n), [float(x) for x in np.round(centres[n % 6] + rng.normal(0, 1, 4), 1)]) for n in range(300)]
    rows += [(name(300 + n), [1.0, 2.0, 3.0, 4.0]) for n in range(40)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 4), (name(900), None)], f"id {kind}, embedding array<double>").repartition(6)
    asked = [r[0] for r in rows[::9]]
    queries = df.where(df["id"].isin(asked))
    got = sorted((r.id, r.near, round(r.distance, 6), r.rank) for r in nearest_to_each(queries, df, 5, pivots=pivots, piece=piece).collect())
    assert got == plain(rows, asked, 5)


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, embedding array<float>")
    assert [tuple(r) for r in nearest_to_each(df, df, 5).orderBy("id").collect()] == [(1, 2, 5.0, 1), (2, 1, 5.0, 1)]
    assert nearest_to_each(df, df.where("false"), 5).count() == 0 == nearest_to_each(df.where("false"), df, 5).count()


def test_far_cells_get_no_queries():
    """Clusters far apart: a query goes to its own only."""
    import pyarrow as pa

    pivots = np.array([[0.0, 0.0], [100.0, 0.0], [0.0, 100.0]])
    cells = {c: (2, 0.0, 2.0, [0.0, 0.5, 0.7, 1.0]) for c in range(3)}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[1.0, 1.0], [99.0, 0.0]])], names=["id", "embedding"])
    (sent,) = _sent(iter([batch]), pivots, cells, 3)
    assert [(r["id"], r["cell"], r["piece"]) for r in sent.to_pylist()] == [(1, 0, 0), (1, 0, 1), (2, 1, 0), (2, 1, 1)]
