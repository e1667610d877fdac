"""Line dedup: two Bloom filters, of hashes seen once and seen twice; only suspected repeats are shuffled, and confirmed by their text.

A line's key is the line without ASCII white space at both ends, A-Z lowered. Keys of at least `least_chars` code points that stand in at
least `least_documents` documents lose all their lines but those of the document with the largest id that holds them.

1. Up to BUILDERS tasks put the hashes of their documents' keys (each once a document) into a pair of filters; the pairs are merged piece
   by piece: what two of them have seen, or one has seen twice, is in the second filter, so no repeat is ever missed.
2. The texts are scanned again with the second filter broadcast. Keys in it are suspected repeats: only these are shuffled, with their
   whole text, counted exactly, and given their last document. The filter's errors cost shuffled rows, never a wrong line.
3. The lines to drop meet the texts by document.

A filter has `filter_bits` bits at most (2**28, that is 32 MB), which serves 16 million keys. For more, the keys are written once, parted
by ranges of the hash without a shuffle, and each range gets a pair of filters of its own in turn: the work stays in proportion to the
input and the broadcast is bounded.

Edges: a null or empty text is one empty line; rows with equal ids are one document when documents are counted, and each gets its own
result; rows without an id stay as they are and count nowhere; equal lines of the last document all stay; a text is worked on whole by
one task; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, named, release, saved, table

WHITE = b" \t\n\v\f\r"
LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
#: Bits of one filter at most, and bits for each key.
FILTER_BITS = 1 << 28
KEY_BITS = 16
#: Tasks that build filters of one range of hashes, and 64-bit words of a filter in one merged row.
BUILDERS = 8
PIECE = 2048


def keys(text: bytes | None, least_chars: int) -> list[bytes]:
    """The key of every line, empty where it is shorter than least_chars code points."""
    found = [line.strip(WHITE) for line in (text or b"").lower().split(b"\n")]
    return [k if len(k) >= least_chars and (k.isascii() or len(k.decode()) >= least_chars) else b"" for k in found]


class SeenTwice:
    """Two Bloom filters of one size. A key's bits are four of one 64-bit word, so that a test reads one place of memory."""

    def __init__(self, bits: int, once: np.ndarray | None = None, twice: np.ndarray | None = None):
        size = bits // 64
        self.once = np.zeros(size, np.uint64) if once is None else once
        self.twice = np.zeros(size, np.uint64) if twice is None else twice

    def _spots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, six = np.uint64(1), np.uint64(63)
        mask = np.zeros(len(hashes), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= one << ((hashes >> np.uint64(shift)) & six)
        return ((hashes >> np.uint64(24)) & np.uint64(len(self.twice) - 1)).astype(np.int64), mask

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of keys, one for each document that holds the key."""
        hashes, times = np.unique(hashes, return_counts=True)
        at, mask = self._spots(hashes)
        again = (times > 1) | (self.once[at] & mask == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        at, mask = self._spots(hashes)
        return self.twice[at] & mask == mask


def _keyed(batches: Iterator[pa.RecordBatch], least_chars: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """(doc, line, hash, block): each key of a document once."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = [sorted({*keys(t, least_chars)} - {b""}) for t in texts]
        lines = [k for row in found for k in row]
        if lines:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
            docs = batch.column("doc").take(pa.array(np.repeat(np.arange(len(found)), [len(row) for row in found])))
            block = ((hashes >> np.uint64(48)) % np.uint64(blocks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([docs, pa.array(lines, pa.binary()), pa.array(hashes.view(np.int64)), pa.array(block)], names=["doc", "line", "hash", "block"])


def _built(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The pieces of this task's filters that have a bit."""
    seen = SeenTwice(bits)
    for batch in batches:
        seen.add(batch.column("hash").to_numpy().view(np.uint64))
    for at in range(0, len(seen.once), PIECE):
        if seen.once[at : at + PIECE].any():
            parts = [[x[at : at + PIECE].tobytes()] for x in (seen.once, seen.twice)]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names=["at", "once", "twice"])


def _merged(pieces: pa.Table) -> pa.Table:
    """One piece of the second filter, from those of all tasks."""
    once, twice = ([np.frombuffer(x, np.uint64) for x in pieces.column(name).to_pylist()] for name in ("once", "twice"))
    seen = SeenTwice(0, once[0].copy(), twice[0].copy())
    for x, y in zip(once[1:], twice[1:], strict=True):
        seen.merge(x, y)
    return pa.table({"at": pieces.column("at")[:1], "twice": pa.array([seen.twice.tobytes()], pa.binary())})


def _suspected(batches: Iterator[pa.RecordBatch], seen: SeenTwice) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(seen.suspects(batch.column("hash").to_numpy().view(np.uint64)))).select(["doc", "line"])


def _suspects(docs: DataFrame, least_chars: int, filter_bits: int) -> DataFrame:
    """(doc, line): each suspected repeat, once for each document that holds it."""
    spark, doc = docs.sparkSession, docs.schema["doc"].dataType.simpleString()
    room = F.least(F.expr("length(text) - length(replace(text, '\n')) + 1"), F.expr(f"length(text) div {least_chars}"))
    most = docs.agg(F.sum(room)).first()[0] or 0
    blocks = max(1, math.ceil(most * KEY_BITS / filter_bits))
    bits = min(filter_bits, 1 << max(17, math.ceil(math.log2(max(1, most * KEY_BITS)))))
    keyed = lambda batches: _keyed(batches, least_chars, blocks)
    if blocks > 1:
        written = saved(docs.mapInArrow(keyed, f"doc {doc}, line binary, hash long, block int"), by="block")
    parts = []
    for block in range(blocks):
        rows, read = (written.where(f"block = {block}"), iter) if blocks > 1 else (docs, keyed)
        pieces = rows.coalesce(BUILDERS).mapInArrow(lambda batches, read=read: _built(read(batches), bits), "at int, once binary, twice binary")
        seen = SeenTwice(bits, np.zeros(0, np.uint64))
        for piece in pieces.groupBy("at").applyInArrow(_merged, "at int, twice binary").collect():
            seen.twice[piece["at"] : piece["at"] + PIECE] = np.frombuffer(piece["twice"], np.uint64)
        known = spark.sparkContext.broadcast(seen)
        found = rows.mapInArrow(lambda batches, read=read, known=known: _suspected(read(batches), known.value), f"doc {doc}, line binary")
        parts.append(saved(found.distinct()))
        known.destroy()
    if blocks > 1:
        release(written)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, drop in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("drop").to_pylist(), strict=True):
            all_lines = (text or b"").split(b"\n")
            gone = set(drop or ())
            kept = [x for x in all_lines if x.lower().strip(WHITE) not in gone] if gone else all_lines
            texts.append(b"\n".join(kept))
            lines.append(len(all_lines))
            dropped.append(len(all_lines) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["key", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(key, text: the lines that stay, n_lines long, n_dropped long) for every row of docs.

    least_documents must be 2 at least; the result columns' names are refused as the name of the key."""
    rows = named(docs, key, text, "n_lines", "n_dropped")
    known = rows.where("key is not null and text is not null").select(F.col("key").alias("doc"), "text")
    pairs = _suspects(known, least_chars, filter_bits)
    counts = saved(pairs.groupBy("line").agg(F.count("*").alias("members"), F.max("doc").alias("keep")).where(F.col("members") >= least_documents))
    gone = meet(pairs, counts, ["line"], spread="doc").where("doc <> keep").groupBy("doc").agg(F.collect_list("line").alias("drop"))
    met = rows.join(gone, F.col("key") == F.col("doc"), "left").select("key", "text", "drop")
    kind = rows.schema["key"].dataType.simpleString()
    return met.mapInArrow(_dropped, f"key {kind}, text string, n_lines long, n_dropped long").withColumnsRenamed({"key": key, "text": text})


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
