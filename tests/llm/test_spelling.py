"""Spelling variants against all pairs of words, and the edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import spelling
from graphloom.llm.spelling import letter_runs, neighbourhood, variant_groups, vocabulary


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}) - {word}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = sorted((a, b), key=len, reverse=True)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best is not None and counts[best] >= ratio * n else None, n, len(others))
    rows = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, k, counts[form] if form is not None else None))
    return sorted(rows)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("bits", [spelling.FILTER_BITS, 64])
def test_equals_all_pairs(spark, bits):
    rng = random.Random(13)
    counts = {}
    for _ in range(120):
        word = "".join(rng.choice("aabé中\U0001f600") for _ in range(rng.randint(1, 6)))
        for v in {word, *rng.sample(sorted(edits(word, "abé")), 3)} - {""}:
            counts[v] = 3 * 2 ** rng.randint(0, 6)
    df = spark.createDataFrame([*((w, n, "x", 1) for w, n in counts.items()), (None, 5, "y", 2), ("ab", None, "y", 3)], "word string, n int, near string, form int")
    assert result(variant_groups(df, filter_bits=bits)) == plain(counts)


def test_chains_ties_and_repeated_rows(spark):
    rows = [("abcde", 64), ("abcdx", 16), ("abcyx", 16), ("abzyx", 4), ("abzy", 1), ("aaaaa", 2), ("aaaa", 9), ("aaaaaa", 9), ("lonely", 3), ("abcde", 64)]
    got = {r[0]: r[1:] for r in result(variant_groups(spark.createDataFrame(rows, "word string, n long")))}
    assert got["abzy"] == ("abzyx", "abcyx", 1, 1, 4) and got["abzyx"] == ("abcyx", "abcyx", 4, 2, 16)
    assert got["abcyx"] == (None, "abcyx", 16, 2, None) and got["abcdx"] == ("abcde", "abcde", 16, 2, 128)
    assert got["abcde"] == (None, "abcde", 128, 1, None) and got["lonely"] == (None, "lonely", 3, 0, None)
    assert got["aaaaa"] == ("aaaa", "aaaa", 2, 2, 9)


def test_candidates_are_distinct_and_complete():
    """With a filter that holds everything, each word of the neighbourhood comes exactly once."""
    full, letters = np.full(64, 2**64 - 1, np.uint64), np.array([97, 98, 99], np.uint32)
    for word in ("a", "aa", "abba", "aabbb", "cab"):
        codes = np.array([[ord(c) for c in word]], np.uint32)
        made = []
        for kind, _, places, chars in neighbourhood(codes, letters, full):
            made += [word[:i] + ("" if kind == "delete" else "abc"[c]) + word[i if kind == "insert" else i + 1 :] for i, c in zip(places, chars, strict=True)]
        assert sorted(made) == sorted(edits(word, "abc"))


def test_runs_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Naïve ××NAÏVE x2y"), (2, None), (3, ""), (None, "zz")], "doc_id long, text string")
    assert sorted((r.key or 0, r.run) for r in letter_runs(df).collect()) == [(0, "zz"), (1, "naïve"), (1, "x"), (1, "y"), (1, "××naÏve")]
    words = vocabulary(letter_runs(df.union(df).union(df)), F.col("run"), least_chars=2)
    assert {r.word: r.n for r in words.collect()}["zz"] == 3
    assert variant_groups(words.where("false")).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        variant_groups(words, ratio=1)
