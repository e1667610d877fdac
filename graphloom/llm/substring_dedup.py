"""Substring deduplication on a sparse De Bruijn graph of the corpus.

Edges are token k-mers, of which the least by hash among every `window + 1 - k` neighbours is picked (about 2 of
window + 2 - k places); a window of words always holds the edge it picks, the same one wherever it occurs,
so a window can repeat only where its edge repeats.

1. Edges are counted over the corpus, together with what follows them: all words up to the end of the next edge
   (summed before the shuffle, so no copied passage is hot).
2. Repeated edges are joined back to their source coordinates (document, number of the edge).
3. Nonbranching paths compact: where every occurrence of an edge is followed by the same words and the next edge
   occurs equally often, they always occur together. A compacted path occurs at least twice as a
   whole, so windows inside it are settled without another look.
4. The other windows, at the ends of paths and across branches, are verified at their source
   coordinates: a 128-bit hash of the window is counted over the corpus and joined back.
5. Covered words are removed from each text.

Only rows that grow with repeated text move after step 2. Rows of a passage that many documents copy are salted by their document
(`meet`), and every step is a written table, whose shuffle files go at once. Hashes are 64-bit for edges and 128-bit for
windows. Edges: null and empty texts give no words; repeated rows are documents like any other
(they repeat each other); texts shorter than the window stay whole; very long texts are worked on one at a time in the memory of
their words; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, release, saved, table
from .tokens import Words, kgrams, mix, pieces, signed

WINDOW = 35


class Graph:
    """Edges of the documents of one piece: of every `spread` neighbouring k-mers of a document the one of least hash is picked,
    where k + spread - 1 = window, so the k-mers of a window pick one edge, the same wherever the window occurs."""

    def __init__(self, words: Words, window: int):
        self.window = window
        self.k = k = -(-window // 3)
        self.spread = spread = window + 1 - k
        n = len(words)
        left = words.left()
        grams = kgrams(words.hashes, k)
        picked = np.zeros(n + 1, bool)
        #: The place that the window from here on picks.
        self.pick = np.zeros(n, np.int64)
        if len(grams) >= spread:
            spans = np.lib.stride_tricks.sliding_window_view(grams, spread)
            whole = np.flatnonzero(left[: len(spans)] >= window)
            for low in range(0, len(whole), 1 << 15):  # leftmost of the least
                some = whole[low : low + (1 << 15)]
                self.pick[some] = some + spans[some].argmin(axis=1)
            picked[self.pick[whole]] = True
        self.places = at = np.flatnonzero(picked)
        self.edges = grams[at] | np.uint64(1) if len(at) else np.zeros(0, np.uint64)
        self.row = row = words.row_of()[at] if n else np.zeros(0, int)
        first = np.searchsorted(row, np.arange(len(words.at) - 1))
        #: Number of the edge in its document.
        self.number = np.arange(len(row)) - first[row]
        # All words from an edge to the end of the next one, as a difference of running sums with powers of one base.
        self.after = np.zeros(len(at), np.uint64)
        if len(at) > 1:
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hashes, 9) * POWER.upto(n), dtype=np.uint64)])
            sums = (run[at[1:] + k] - run[at[:-1]]) * POWER.inverse(n)[at[:-1]]
            same = row[1:] == row[:-1]
            self.after[:-1] = np.where(same, mix(sums + np.diff(at).astype(np.uint64), 5) | np.uint64(1), 0)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def _table(self, i: int, n: int) -> np.ndarray:
        if len(self.tables[i]) < n:
            table_ = np.full(2 * n, (self.base, self.back)[i], np.uint64)
            table_[0] = 1
            self.tables[i] = np.cumprod(table_, dtype=np.uint64)
        return self.tables[i][:n]

    def upto(self, n: int) -> np.ndarray:
        return self._table(0, n)

    def inverse(self, n: int) -> np.ndarray:
        return self._table(1, n)


POWER = Powers(0xB5297A4D3F84D5B5)


def _edges(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        graph = Graph(Words(batch.column("text")), window)
        home = batch.column("home").to_numpy(zero_copy_only=False)
        for low in range(0, len(graph.edges), 1 << 17):
            some = np.arange(low, min(low + (1 << 17), len(graph.edges)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(graph.edges[some]), signed(graph.after[some]), home[graph.row[some]], graph.number[some].astype(np.int32))], names=["edge", "after", "home", "number"])


def _marks(graph: Graph, words: Words, packed: list) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: settled, and open (to be verified)."""
    n, k, window, places = len(words), graph.k, graph.window, graph.places
    repeated, linked, count = np.zeros(len(places), bool), np.zeros(len(places), bool), np.zeros(len(places), np.int64)
    first = np.searchsorted(graph.row, np.arange(len(words.at) - 1))
    for r, values in enumerate(packed):
        if values is not None and len(values):
            values = np.asarray(values, np.int64)
            at = first[r] + (values >> 33)
            repeated[at], linked[at], count[at] = True, values & 1, (values >> 1) & 0xFFFFFFFF
    settled, unsure = np.zeros(n, bool), np.zeros(n, bool)
    start = np.flatnonzero(words.left() >= window)
    if not len(start) or not repeated.any():
        return settled, unsure
    joined = np.zeros(len(places), bool)  # this edge and the one before it are on one path
    joined[1:] = linked[:-1] & repeated[:-1] & repeated[1:] & (count[:-1] == count[1:]) & (graph.row[1:] == graph.row[:-1])
    path = np.cumsum(~joined)
    candidate = repeated[np.searchsorted(places, graph.pick[start])]
    low, high = np.searchsorted(places, start, "right") - 1, np.searchsorted(places, start + (window - k))
    a, b = np.maximum(low, 0), np.minimum(high, len(places) - 1)
    rows = words.row_of()[start]
    inside = (low >= 0) & (high < len(places)) & (graph.row[a] == rows) & (graph.row[b] == rows) & (path[a] == path[b]) & repeated[a]
    settled[start[inside]] = True
    unsure[start[candidate & ~inside]] = True
    return settled, unsure


def _open_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = Words(batch.column("text"))
        _, unsure = _marks(Graph(words, window), words, batch.column("known").to_pylist())
        at = np.flatnonzero(unsure)
        if len(at):
            one, two = (signed(kgrams(words.hashes, window, salt)[at]) for salt in (1, 2))
            row = words.row_of()[at]
            home = batch.column("home").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, home[row], (at - words.at[row]).astype(np.int32))], names=["one", "two", "home", "place"])


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        known, found = batch.column("known").to_pylist(), batch.column("found").to_pylist()
        some = [r for r in range(batch.num_rows) if known[r]]
        covered: dict[int, np.ndarray] = {}
        if some:
            words = Words(batch.column("text").take(pa.array(some)))
            settled, _ = _marks(Graph(words, window), words, [known[r] for r in some])
            for i, r in enumerate(some):
                low, high = int(words.at[i]), int(words.at[i + 1])
                step = np.zeros(high - low + 1, np.int64)
                starts = np.union1d(np.flatnonzero(settled[low:high]), np.asarray(found[r] or [], np.int64))
                np.add.at(step, starts, 1)
                np.add.at(step, starts + window, -1)
                covered[r] = np.cumsum(step[:-1]) > 0
        texts, sizes, gone = [], [], []
        for r, text in enumerate(batch.column("text").to_pylist()):
            parts = (text or "").encode().split()
            sizes.append(len(parts))
            mask = covered.get(r)
            if mask is not None and mask.any():
                parts = [parts[i] for i in np.flatnonzero(~mask).tolist()]
            gone.append(sizes[-1] - len(parts))
            texts.append(b" ".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["key", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept): kept has the words of the text that no repeated window covers, joined by a space."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("home"))
    edges = source.select("home", "text").mapInArrow(lambda b: _edges(b, window), "edge long, after long, home long, number int")
    counted = edges.groupBy("edge").agg(F.count("*").alias("members"), F.min("after").alias("least"), F.max("after").alias("most")).where("members > 1")
    paths = saved(counted.select("edge", "members", F.least("members", F.lit((1 << 32) - 1)).alias("n"), F.expr("least = most and least <> 0").cast("long").alias("link")))
    packed = F.shiftleft(F.col("number").cast("long"), 33) + F.shiftleft("n", 1) + F.col("link")
    found = meet(edges.select("edge", "home", "number"), paths, ["edge"], spread="home").select("home", packed.alias("one"))
    known = saved(found.groupBy("home").agg(F.collect_list("one").alias("known")))
    lit = source.join(known, "home").select("home", "text", "known")
    windows = saved(lit.mapInArrow(lambda b: _open_windows(b, window), "one long, two long, home long, place int"))
    twice = saved(windows.groupBy("one", "two").agg(F.count("*").alias("members")).where("members > 1"))
    more = saved(meet(windows, twice, ["one", "two"], spread="home").groupBy("home").agg(F.collect_list("place").alias("found")))
    release(paths, windows, twice)
    joined = source.join(known.join(more, "home", "left"), "home", "left").select("key", "text", "known", "found")
    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(lambda b: _kept(b, window), f"key {kind}, n_words long, n_removed long, kept string").withColumnRenamed("key", key)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
