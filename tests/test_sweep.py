"""The sweep against all spans of every point, on files of any shape."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators.resolve import enclosing
from graphloom.operators.sweep import innermost


def plain(points, spans):
    out = {}
    for file, line in points:
        around = [(a, i) for f, a, b, i in spans if file is not None and f == file and None not in (a, b, line) and a <= line <= b]
        out[file, line] = max(around)[1] if around else None
    return sorted(((*k, v) for k, v in out.items()), key=str)


@pytest.mark.parametrize("stretch", [3, 10, 1 << 16])
def test_equals_all_spans(spark, stretch):
    rng = random.Random(18)
    spans = []
    for n in range(400):
        a = rng.randint(-5, 200)
        spans.append((rng.choice("abc"), a, a + rng.choice([-1, 0, 1, 5, 60, 300]), f"s{n:03}"))
    spans += [("d", 1, 10**6, f"t{n}") for n in range(50)] + [(None, 1, 9, "x"), ("a", None, 9, "y"), ("a", 5, None, "z"), spans[0]]
    points = [(rng.choice("abcde"), rng.randint(-10, 300)) for _ in range(600)] + [(None, 4), ("a", None), ("d", 10**6), ("d", 10**6 + 1)]
    lines = spark.createDataFrame([(*p, 1) for p in points], "file string, line int, id int").repartition(7)
    symbols = spark.createDataFrame([(*s, "x") for s in spans], "file string, start_line int, end_line int, id string, line string")
    got = sorted(((r.file, r.line, r.id) for r in innermost(lines, symbols, stretch=stretch).collect()), key=str)
    assert got == plain(points, spans)


def test_one_long_file(spark):
    """A million lines under nested and disjoint symbols: seconds, and no task has the file whole."""
    n = 1_000_000
    points = spark.range(1, n + 1).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    spans = spark.range(n // 4).select(F.lit("f").alias("file"), (F.col("id") * 4 + 1).alias("start_line"), (F.col("id") * 4 + 3).alias("end_line"), F.format_string("s%07d", "id").alias("id"))
    nest = spark.range(1, 200).select(F.lit("f").alias("file"), F.col("id").alias("start_line"), (F.lit(n) - F.col("id")).alias("end_line"), F.format_string("n%07d", "id").alias("id"))
    began = time.time()
    got = enclosing(points, spans.unionByName(nest)).groupBy(F.substring("symbol", 1, 1).alias("kind")).count().collect()
    assert time.time() - began < 60
    counts = {r.kind: r["count"] for r in got}
    # In the first 199 lines a nested symbol starts on each, so the small ones keep but their first line: 50 of 150.
    assert counts == {"s": 750_000 - 100, "n": 250_000 + 100 - 1, "u": 1}


def test_empty_sides(spark):
    lines = spark.createDataFrame([("a", 1)], "file string, line long")
    symbols = spark.createDataFrame([], "file string, start_line long, end_line long, id string")
    assert [tuple(r) for r in enclosing(lines, symbols).collect()] == [("a", 1, "unknown:a:1")]
    assert enclosing(lines.where("false"), symbols).count() == 0
