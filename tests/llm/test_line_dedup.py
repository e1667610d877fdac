"""Line dedup against plain Python, with one filter and with ranges of hashes, and its edges."""

import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import line_dedup
from graphloom.llm.line_dedup import SeenTwice, dedup_lines

WHITE = " \t\n\v\f\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least_chars=20, least_documents=3):
    key = lambda line: lower(line.strip(WHITE))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n") if doc is not None else ():
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders[key(x)]) < least_documents or max(holders[key(x)]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def some_rows():
    rng = random.Random(11)
    common = [f"A common line of the page number {i}é " for i in range(40)]
    rows = []
    for doc in range(300):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"line {rng.random()} of this document" for _ in range(rng.randint(1, 12))]
        lines += [rng.choice(["", "short", "\tA COMMON LINE OF THE PAGE NUMBER 7É", "  a common line of the page number 7é\r", "exactly 20 points éé", "just 19 points ééé.", " not ascii white space "])]
        rng.shuffle(lines)
        rows.append((doc, "\n".join(lines)))
    return [*rows, (300, None), (301, ""), (302, "\n\n"), (5, rows[9][1]), (5, rows[9][1]), (None, rows[3][1]), (303, "A common line of the page number 1é\n" * 5000)]


@pytest.mark.parametrize("bits", [1 << 28, 1 << 13])
def test_equals_plain_python(spark, bits):
    rows = some_rows()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, drop string").repartition(13)
    assert result(dedup_lines(df, filter_bits=bits)) == plain(rows)
    if bits < 1 << 20:
        assert result(dedup_lines(df, filter_bits=bits, least_documents=2)) == plain(rows, least_documents=2)


def test_names_empty_tables_and_other_ids(spark):
    line = "a line of more than twenty points"
    df = spark.createDataFrame([(x, line) for x in "abc"] + [("b", "own text")], "`my.doc` string, line string")
    got = sorted(map(tuple, dedup_lines(df, key="my.doc", text="line").collect()))
    assert got == [("a", "", 1, 1), ("b", "", 1, 1), ("b", "own text", 1, 0), ("c", line, 1, 0)]
    assert dedup_lines(df.where("false"), key="my.doc", text="line").count() == 0
    with pytest.raises(ValueError, match="n_lines"):
        dedup_lines(df.withColumnRenamed("my.doc", "n_lines"), key="n_lines", text="line")


def test_filters_miss_no_repeat():
    """Whatever task sees a key first or second; and few of the others are suspected."""
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 20000).astype(np.uint64)
    repeated = hashes[:2000]
    shares = np.array_split(rng.permutation(np.concatenate([hashes, repeated])), 7)
    whole = SeenTwice(1 << 19)
    for share in shares:
        seen = SeenTwice(1 << 19)
        for part in np.array_split(share, 3):
            seen.add(part)
        whole.merge(seen.once, seen.twice)
    assert whole.suspects(repeated).all()
    assert whole.suspects(hashes[2000:]).mean() < 0.02


def test_only_suspects_are_shuffled(spark):
    rows = [(d, f"line {d} that no other document holds\nthe footer of all the pages") for d in range(2000)]
    df = spark.createDataFrame(rows, "doc long, text string")
    assert 2000 <= line_dedup._suspects(df, 20, 1 << 28).count() < 2100
