"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

A-Z is lowered and words are runs of digits, a-z and characters beyond ASCII. Every window of `window`
consecutive words of a benchmark item (or the whole item, if it is shorter) goes into a hash set; each
text is scanned once with rolling hashes, every hit is verified against the words themselves, and the
words inside verified occurrences are marked.

The hash set is flat arrays: 24 bytes a window besides its share of the text. It is broadcast in blocks of about BLOCK_CHARS characters of
benchmark text (an item is never split), so 50 MB or so at once, however large the benchmark is. With one block the texts are scanned once
and nothing is shuffled. With more, each block's scan writes down the hits of the texts that have any, its broadcast goes, and
the hits of all blocks meet the texts in the end.

Edges: null or empty texts have no words and no hits; items without words or without an id are ignored; repeated items
all count under their own ids, rows with equal ids are one item in the list of ids; repeated rows of documents are marked alike; very long
texts are worked on one at a time in the memory of their words; an empty benchmark leaves everything clean, an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .tokens import ALNUM, Words, kgrams, lists, pieces

WINDOW = 10
BLOCK_CHARS = 8_000_000


class HashSet:
    """Windows of some benchmark items: by length, sorted hashes, where each window stands in the normalised texts, and its item's number."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        words = Words(pa.array([text for _, text in items], pa.string()), ALNUM, True)
        # Words joined by one space, all items in a row.
        length = words.ends - words.starts
        at = np.cumsum(length + 1) - (length + 1)
        text = np.full(int((length + 1).sum()), 0x20, np.uint8)
        first = np.cumsum(length) - length
        step = np.arange(int(length.sum()))
        text[step + np.repeat(at - first, length)] = words.data[step + np.repeat(words.starts - first, length)]
        self.text = text.tobytes()
        row, left = words.row_of(), words.left()
        sizes = np.minimum(words.counts, window)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            start = np.flatnonzero((sizes[row] == size) & (left >= size))
            hashes = kgrams(words.hashes, size)[start]
            order = np.argsort(hashes, kind="stable")
            start = start[order]
            low, high = at[start], at[start + size - 1] + length[start + size - 1]
            self.by_length[size] = (hashes[order], low, (high - low).astype(np.int32), row[start].astype(np.int32))

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """A mark for each word, and the item numbers found in each row."""
        hit, items = np.zeros(len(words) + 1, np.int32), {}
        left, rows = words.left(), words.row_of()
        for size, (keys, low, length, owner) in self.by_length.items():
            grams = kgrams(words.hashes, size)
            place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            found = np.flatnonzero((keys[place] == grams) & (left[: len(grams)] >= size))
            ends = np.searchsorted(keys, grams[found], "right")
            for at, begin, end in zip(found.tolist(), place[found].tolist(), ends.tolist(), strict=True):
                own, met = sequence(words, at, size), False
                for i in range(begin, end):  # all windows of this hash, each verified
                    if length[i] == len(own) and self.text.startswith(own, int(low[i])):
                        met = True
                        items.setdefault(int(rows[at]), set()).add(int(owner[i]))
                if met:
                    hit[at] += 1
                    hit[at + size] -= 1
        return np.cumsum(hit[:-1]) > 0, items


def sequence(words: Words, at: int, size: int) -> bytes:
    data, starts, ends = words.data, words.starts, words.ends
    return b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(at, at + size))


def _marked(docs: DataFrame, benchmark: DataFrame, apply, schema: str, *, key: str, text: str, item: str, item_text: str, window: int, block_chars: int) -> DataFrame:
    """apply(batches, hash set) over (key, text, hits, items), where hits and items are those of the blocks before the last one."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("body")).where("item is not null and body is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("body"))).first()[0] or 0) / block_chars))
    part = lambda block: items.where(F.expr(f"pmod(xxhash64(item, body), {blocks}) = {block}")).orderBy("item", "body").collect()
    known = lambda block: spark.sparkContext.broadcast(HashSet([(r["item"], r["body"]) for r in part(block)], window))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    none = rows.select("key", "text", F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    if blocks > 1:
        parts = []
        for block in range(blocks - 1):
            set_ = known(block)
            narrow = none.mapInArrow(lambda batches, set_=set_: _mark(batches, set_.value), f"{none.schema.simpleString()[7:-1]}, n_words long").where("size(hits) > 0")
            parts.append(saved(narrow.select(F.xxhash64("text").alias("home"), "hits", "items").dropDuplicates(["home"])))
            set_.destroy()
        found = reduce(DataFrame.unionByName, parts).groupBy("home").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        with_home = rows.withColumn("home", F.xxhash64("text"))
        none = with_home.join(saved(found), "home", "left").select("key", "text", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    last = known(blocks - 1)
    return none.mapInArrow(lambda batches: apply(batches, last.value), schema.format(key=docs.schema[key].dataType.simpleString()))


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, text, n_words long, hits array<int>: numbers of the hit words, items array<string>) for every row of docs."""
    out = _marked(docs, benchmark, _mark, "key {key}, text string, hits array<int>, items array<string>, n_words long", key=key, text=text, item=item, item_text=item_text, window=window, block_chars=block_chars)
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "n_words", "hits", "items")


def _mark(batches: Iterator[pa.RecordBatch], known: HashSet) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = Words(batch.column("text"), ALNUM, True)
        hit, items = known.scan(words)
        old = batch.column("hits").to_pylist()
        marks = [np.flatnonzero(hit[words.at[r] : words.at[r + 1]]) for r in range(batch.num_rows)]
        marks = [np.union1d(m, old[r]) if old[r] else m for r, m in enumerate(marks)]
        names = [sorted({*was, *(known.names[i] for i in items.get(r, ()))}) for r, was in enumerate(batch.column("items").to_pylist())]
        at = np.cumsum([0, *map(len, marks)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("text"), lists(at, pa.array(np.concatenate([*marks, np.zeros(0, int)]).astype(np.int32))), pa.array(names, pa.list_(pa.string())), pa.array(words.counts, pa.int64())],
            names=["key", "text", "hits", "items", "n_words"],
        )


def _without(batches: Iterator[pa.RecordBatch], known: HashSet, drop_share: float) -> Iterator[pa.RecordBatch]:
    for batch in _mark(batches, known):
        stays = np.array([len(h) for h in batch.column("hits").to_pylist()]) <= drop_share * batch.column("n_words").to_numpy()
        batch = batch.filter(pa.array(stays))
        words, texts = Words(batch.column("text"), ALNUM, True, hashed=False), []
        column = batch.column("text").to_pylist()
        for r, hits in enumerate(batch.column("hits").to_pylist()):
            if not hits:
                texts.append(column[r])
                continue
            source, kept, at = column[r].encode(), [], 0
            runs = np.split(np.array(hits), np.flatnonzero(np.diff(hits) > 1) + 1)
            for run in runs:
                low, high = (int(x) + int(words.at[r]) for x in (run[0], run[-1]))
                kept.append(source[at : words.starts[low] - words.offsets[r]])
                at = int(words.ends[high] - words.offsets[r])
                if not kept[-1] or kept[-1][-1:].isspace():
                    while source[at : at + 1] == b" ":
                        at += 1
            texts.append(b"".join([*kept, source[at:]]).decode())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, drop_share: float = 0.5, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents without the hit words; a document is dropped where more than drop_share of its words are hit.

    Returns (key, text) of all documents that stay, clean ones unchanged. The last block's scan cuts the words out too."""
    out = _marked(docs, benchmark, lambda batches, known: _without(batches, known, drop_share), "key {key}, text string, hits array<int>, items array<string>, n_words long", key=key, text=text, item=item, item_text=item_text, window=window, block_chars=block_chars)
    return out.select(F.col("key").alias(key), F.col("text").alias(text))


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    marked = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return marked.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
