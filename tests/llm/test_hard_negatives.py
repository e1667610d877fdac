"""Hard negatives against brute force: copies, ties, windows of every sign, many pieces and blocks; the tree's traversal by itself."""

import math
import random

import numpy as np
import pytest

from graphloom.llm.hard_negatives import Best, Piece, Tree, _augmented, grow, hard_negatives


def plain(rows, anchors, k=5, m=10):
    known = {}
    for i, label, vector in rows:
        if i is not None and label is not None and vector is not None and None not in vector:
            known[i] = min(known.get(i, (label, vector)), (label, vector))
    out = []
    for a in sorted({x for x in anchors if x in known}):
        label, v = known[a]
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=False))  # noqa: B023, E731
        ranked = sorted(((-score(w), i, other) for i, (other, w) in known.items() if i != a))
        for s, p, _ in [r for r in ranked if r[2] == label][:k]:
            fits = [(-t, i) for t, i, other in ranked if other != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(fits[:m], 1)]
    return sorted(out)


def some_rows(n=400, width=6):
    rng = random.Random(12)
    centres = [[rng.randint(-200, 200) for _ in range(width)] for _ in range(8)]
    rows = [(i, rng.randint(0, 3), [x + rng.randint(-40, 40) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, i % 3, centres[0]) for i in range(150)] + [(n + 150 + i, 1, [0] * width) for i in range(20)]
    rows += [(n + 200, 2, [300, 5]), (n + 201, 2, []), (None, 1, centres[1]), (n + 202, None, centres[1]), (n + 203, 1, None), (n + 204, 1, [1, None, 3])]
    return [*rows, rows[3], (7, 3, centres[2]), (n + 205, 9, centres[3])]


@pytest.mark.parametrize(("shard", "leaf", "block"), [(16384, 256, 16384), (64, 4, 7)])
def test_equals_brute_force(spark, shard, leaf, block):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label long, vector array<long>, row string, score int").repartition(5)
    anchors = [r[0] for r in rows if r[0] is not None and r[0] % 17 == 0] + [600, 601, 605, 99999]
    wanted = spark.createDataFrame([(i,) for i in [*anchors, *anchors]], "id long")
    got = sorted(map(tuple, hard_negatives(df, wanted, shard=shard, leaf=leaf, block_anchors=block).collect()))
    assert got == plain(rows, anchors)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, [1, 2]), (2, 1, [2, 2])], "id long, label long, vector array<long>")
    assert hard_negatives(df.where("false"), df.select("id")).count() == 0
    assert hard_negatives(df, df.select("id").where("false")).count() == 0
    assert hard_negatives(df, df.select("id")).count() == 0  # no positives


def test_traversal_is_nearest_first_and_skips(spark):
    """Leaves come in the order of their bounds, everything inside a window is met, and far leaves are never opened."""
    rng = np.random.default_rng(4)
    x = np.rint(np.repeat(rng.normal(0, 200, (40, 5)), 50, axis=0) + rng.normal(0, 5, (2000, 5))).astype(np.int64)
    most = float((x**2).sum(axis=1).max())
    order, tree = grow(_augmented(x, most), 16)
    row = {"ids": np.arange(2000)[order].tobytes(), "labels": np.zeros(2000, np.int64).tobytes(), "vectors": x[order].tobytes()}
    row |= {name: getattr(tree, name).tobytes() for name in Tree.NAMES}
    anchors = x[::100].astype(float)
    piece = Piece(row, 5, most, anchors, (anchors**2).sum(axis=1))
    opened = 0
    for a in range(len(anchors)):
        scores = x @ x[::100][a]
        best = Best(5)
        for places, found in piece.nearest(a, -math.inf, math.inf, best.least):
            best.add(found, piece.ids[places])
            opened += 1
        want = np.lexsort((np.arange(2000), -scores))[:5]
        assert best.ids.tolist() == want.tolist() and best.scores.tolist() == scores[want].tolist()
        low, high = float(np.quantile(scores, 0.6)), float(np.quantile(scores, 0.7))
        inside = [i for places, _ in piece.nearest(a, low, high, lambda: -math.inf) for i in piece.ids[places]]
        assert sorted(inside) == np.flatnonzero((scores >= low) & (scores <= high)).tolist()
    leaves = int((tree.point < 0).sum())
    assert opened < len(anchors) * leaves / 2
