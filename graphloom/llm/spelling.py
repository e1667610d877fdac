"""Spelling variant grouping by full neighbourhood generation.

Every word's neighbourhood is generated: all distinct deletions of one code point, replacements by and insertions of each character of the
observed alphabet. A candidate that is a word of the vocabulary is near by construction, so candidates meet the vocabulary in one
equi-join and no distance is ever computed.

A word of eight letters has some 900 candidates at 50 characters. They are made as hashes, whole arrays at a time (a polynomial over the
characters, of which each edit changes a few terms), and looked up in a Bloom filter of the vocabulary, which is broadcast; only those
that may be words become strings and rows. The filter has `filter_bits` bits at most (32 MB); a vocabulary of more than 8 million words
makes it fuller and lets more false candidates into the join, which drops them: the result is the same.

A candidate that two edits give is made once: of a run of equal characters the first is deleted and an insertion goes behind the run.

A word's form is its near word with the largest count, ties by code-point order, if that count is at least `ratio` times its own. Counts
at least double along forms, so they make no circles and no chain is longer than the logarithm of the largest count: roots spread from the
words without a form, one link a round. A word has no more near words than its neighbourhood has candidates, so no key of a join is hot.

Edges: null words and null counts take no part; repeated rows of a word add up; an empty vocabulary gives an empty result; words of one
code point and of any script are allowed; other columns are not read. Nothing is compared but code points, so composed and
decomposed accents differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .tokens import mix

FILTER_BITS = 1 << 28
KEY_BITS = 32
BUILDERS = 8
#: Candidates that are looked up at once.
STEP = 1 << 19
#: Candidates of one task, about: a narrow table of words is dealt out again, as each word brings hundreds.
TASK = 1 << 25
#: An odd number, so that it has an inverse modulo 2**64, by which a deletion shifts the rest of the word.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of equal length with their code points, a row each."""
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    for length, group in sorted(groups.items()):
        yield group, np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(len(group), length)


def _places(sums: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of words' hash sums: the 64-bit word of the filter and the four bits there."""
    hashes = mix(sums, length)
    mask = np.uint64(1) << (hashes & np.uint64(63))
    for shift in (6, 12, 18):
        mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return ((hashes >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64), mask


def _sums(codes: np.ndarray) -> np.ndarray:
    """Hash sums of the beginnings of each word: [words, length + 1]."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64)) * _powers(codes.shape[1] + 1)[:-1], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def _filled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """This task's words in a filter of their own."""
    bits = np.zeros(size, np.uint64)
    for batch in batches:
        for _, codes in _by_length(batch.column("word").to_pylist()):
            at, mask = _places(_sums(codes)[:, -1], codes.shape[1], size)
            np.bitwise_or.at(bits, at, mask)
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray, known: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind of edit, word, place, character of the alphabet) of all distinct candidates that the filter takes for words."""
    n, length = codes.shape
    begin = _sums(codes)
    total, power, letters = begin[:, -1:, None], _powers(length + 1), mix(alphabet.astype(np.uint64))
    own = mix(codes.astype(np.uint64))

    def found(sums: np.ndarray, size: int, distinct: np.ndarray) -> tuple[np.ndarray, ...]:
        at, mask = _places(sums, size, len(known))
        return np.nonzero((known[at] & mask == mask) & distinct)

    first = np.ones((n, length, 1), bool)
    first[:, 1:, 0] = codes[:, 1:] != codes[:, :-1]
    yield "delete", *found(begin[:, :-1, None] + (total - begin[:, 1:, None]) * np.uint64(INVERSE), length - 1, first)
    other = codes[:, :, None] != alphabet
    yield "replace", *found(total + (letters - own[:, :, None]) * power[:-1, None], length, other)
    behind = np.concatenate([other, np.ones((n, 1, len(alphabet)), bool)], axis=1)
    yield "insert", *found(begin[:, :, None] + letters * power[:, None] + (total - begin[:, :, None]) * np.uint64(BASE), length + 1, behind)


def _candidates(batches: Iterator[pa.RecordBatch], alphabet: str, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, near): candidates that may be words of the vocabulary."""
    letters = np.array([ord(c) for c in alphabet], np.uint32)
    for batch in batches:
        for words, codes in _by_length(batch.column("word").to_pylist()):
            step = max(1, STEP // ((codes.shape[1] + 1) * len(letters)))
            for low in range(0, len(words), step):
                pairs: list[tuple[str, str]] = []
                for kind, rows, places, chars in neighbourhood(codes[low : low + step], letters, known):
                    for row, i, c in zip(rows.tolist(), places.tolist(), chars.tolist(), strict=True):
                        word = words[low + row]
                        pairs.append((word, word[:i] + ("" if kind == "delete" else alphabet[c]) + word[i if kind == "insert" else i + 1 :]))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["word", "near"])


def near_pairs(words: DataFrame, *, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(word, near, near_n) for a written table (word, n) of distinct words: all pairs one edit apart, in both directions."""
    spark = words.sparkSession
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
    count = words.count()
    size = min(filter_bits, 1 << max(12, math.ceil(math.log2(max(1, count * KEY_BITS))))) // 64
    parts = words.select("word").coalesce(BUILDERS).mapInArrow(lambda batches: _filled(batches, size), "bits binary").toLocalIterator()
    filled = reduce(np.bitwise_or, (np.frombuffer(p["bits"], np.uint64) for p in parts), np.zeros(size, np.uint64))
    known = spark.sparkContext.broadcast(filled)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(count * len(alphabet) * 20 / TASK))
    found = words.select("word").repartition(tasks, "word").mapInArrow(lambda batches: _candidates(batches, alphabet, known.value), "word string, near string")
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def variant_groups(words: DataFrame, *, ratio: int = 2, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(word, form, root string, n, n_near, form_n long) for the words of (word, n); root: follow forms from the word to the last.

    ratio must be more than 1, so that forms make no circles."""
    if ratio <= 1:
        raise ValueError("ratio must be more than 1")
    words = saved(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")))
    best = near_pairs(words, filter_bits=filter_bits).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    met = words.join(best, "word", "left").withColumn("most", -F.col("best.less"))
    has = F.col("most") >= ratio * F.col("n")
    forms = saved(met.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("most")).alias("form_n")))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    levels = [forms.where("form is null").withColumn("root", F.col("word")).select(columns)]
    linked, front = forms.where("form is not null"), levels[0]
    while True:
        front = saved(linked.join(front.select(F.col("word").alias("form"), "root"), "form").select(columns))
        if front.isEmpty():
            return reduce(DataFrame.union, levels)
        levels.append(front)


def vocabulary(runs: DataFrame, word: Column, *, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the values of an expression over the rows, of least_chars code points and least_count occurrences at least."""
    words = runs.select(word.alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letter_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, run): every maximal run of A-Z, a-z and U+00C0 to U+00FF of every whole text, A-Z lowered."""
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Runs of less than five code points give no word, so they go before the slip (the contract's lost character) is made. A null id counts as an empty one."""
    runs = letter_runs(table(spark, sf_dir, "documents")).where("length(run) >= 5").withColumn("h", F.expr("crc32(encode(concat(coalesce(string(key), ''), ':', run), 'UTF-8'))"))
    slip = F.expr("case when h % 97 = 0 then concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2)) else run end")
    return variant_groups(vocabulary(runs, slip))
