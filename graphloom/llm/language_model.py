"""Prediction by partial matching, and the unigram base it is compared with.

Texts are lowered (A-Z) and read as words `[^\x20\x09-\x0D]+` joined by one space and closed by one end symbol, so both
models predict the same thing. The byte-context trie (contexts of up to ORDER bytes) is counted over all
training documents and every counted node is kept, so the model grows with the corpus. Symbols get
PPM-D probabilities: in a context of d symbols seen n times, a symbol seen c times has (c - 1/2) / n and the escape d / 2n;
after an escape the symbols of the longer context are excluded.

Grams travel packed: a row holds a sorted run of grams of one bucket (differences by byte plane, compressed: about two
bytes a gram), never a gram a row. Buckets go by a hash of the oldest bytes of the context, one for each BUCKET_BYTES of text, so a context
with its 256 symbols at most is in one bucket.

Documents are dealt to groups of about GROUP_BYTES of text by a hash. A group sends each of its words and grams once, with its own
counts in training documents; a bucket adds them up and answers every group in the order of its question; the answers meet the
group's texts again. So no frequent gram or word has more entries than there are groups. Grams that training documents don't hold (of
held-out documents alone) escape: they go on to the counts of contexts that are one byte shorter, a written table a depth, with the symbols excluded so
far as a bit set. The last two depths have at most 2**16 nodes and are broadcast.

Edges: a null text counts as empty (one token, the end); without training documents all counts are 0 and every
byte is equally likely; an empty table gives an empty result; equal texts score alike, and rows with equal ids are scored each for itself; a text larger than
GROUP_BYTES makes its group as large as itself; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table
from .tokens import Words, mix, pieces

ORDER, GROUP_BYTES, BUCKET_BYTES = 7, 10_000_000, 8_000_000
#: Distinct grams that a task gathers before it sends or merges them, and symbols that it compares at once.
HELD, COMPARED = 2_000_000, 2_000_000
#: The longest contexts whose nodes (2**16 at most) are broadcast.
SHALLOW = 1
END = 0x0A  # a separator, so never part of a word
WIDE = np.dtype(">u8")


def stream(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical bytes of all rows, each led by ORDER end symbols; the places of predicted symbols; and their offsets by row."""
    length = words.ends - words.starts
    rows = len(words.at) - 1
    cost = np.concatenate([[0], np.cumsum(length + 1)])
    size = cost[words.at[1:]] - cost[words.at[:-1]]
    size[words.counts == 0] = 1
    base = np.concatenate([[0], np.cumsum(size + ORDER)])
    out = np.full(base[-1], 0x20, np.uint8)
    begin = cost[:-1] + (base[:-1] + ORDER - cost[words.at[:-1]])[words.row_of()]
    if len(length):
        first = np.cumsum(length) - length
        step = np.arange(length.sum())
        out[step + np.repeat(begin - first, length)] = words.data[step + np.repeat(words.starts - first, length)]
    out[base[1:] - 1] = END
    lead = (base[:-1, None] + np.arange(ORDER)).ravel()
    out[lead] = END
    told = np.ones(len(out), bool)
    told[lead] = False
    return out, np.flatnonzero(told), np.concatenate([[0], np.cumsum(size)])[: rows + 1]


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """ORDER + 1 bytes up to each predicted symbol, as one number, and their offsets by row."""
    out, told, at = stream(words)
    windows = np.ndarray((max(0, len(out) - ORDER),), WIDE, out, strides=(1,))
    return windows[told - ORDER].astype(np.uint64), at


# Packed runs ---------------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    x = np.ascontiguousarray(x).view(np.uint64)
    size = 8 if len(x) and int(x.max()) >> 32 else 4
    raw = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size)
    return bytes([size]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw.T).tobytes())


def _from_planes(blob: bytes) -> np.ndarray:
    size = blob[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{size}").ravel().astype(np.uint64)


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(blob: bytes | None) -> np.ndarray:
    return np.cumsum(_from_planes(blob), dtype=np.uint64) if blob else np.zeros(0, np.uint64)


def counts_of(blob: bytes | None) -> np.ndarray:
    return _from_planes(blob).view(np.int64) if blob else np.zeros(0, np.int64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    first = _starts(x)
    return zip(first.tolist(), [*first[1:].tolist(), len(x)][: len(first)], strict=True)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = _starts(key)
    return key[first], (np.add.reduceat(n, first) if len(first) else n)


def _mask(depth: int) -> np.uint64:
    """The bytes of a context and its symbol."""
    return np.uint64((1 << 8 * (depth + 1)) - 1)


def bucket_of(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """The bucket of each gram by its context of `depth` bytes; of long ones by all but the last byte, so that runs stay dense."""
    return (mix((keys & _mask(depth)) >> np.uint64(16 if depth > 4 else 8), depth) % np.uint64(buckets)).astype(np.int32)


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each bucket's members, in their order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    held = bucket[order]
    for low, high in _runs(held):
        yield int(held[low]), order[low:high]


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


# Counting ------------------------------------------------------------------------------------------------------------

COUNTS = "bucket int, grams binary, gram_n binary"


def _arrow(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


class _Gathered:
    """Sums of numbers by key."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, n: np.ndarray) -> bool:
        """Whether there are more than HELD keys; merged often enough to hold few of them twice."""
        self.parts.append((key, n))
        self.size += len(key)
        return self.size > 2 * HELD and len(self.merged()[0]) > HELD

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            parts = self.parts or [none]
            self.parts = [_summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            self.size = len(self.parts[0][0])
        return self.parts[0]


def _word_keys(words: Words) -> np.ndarray:
    """Hashes of all words and a 0 for the end of each row."""
    return np.concatenate([words.hashes, np.zeros(len(words.at) - 1, np.uint64)])


def _added(keys: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = keys.to_pylist(), counts.to_pylist()
    return _summed(np.concatenate([unpack(None), *map(unpack, keys)]), np.concatenate([counts_of(None), *map(counts_of, counts)]))


def _merged(rows: pa.Table) -> pa.Table:
    """One row of a bucket from all of them."""
    key, n = _added(rows["grams"], rows["gram_n"])
    return pa.Table.from_batches([_arrow(COUNTS, [{"bucket": rows["bucket"][0].as_py(), "grams": pack(key), "gram_n": _planes(n)}])])


def _sent(gram: tuple[np.ndarray, np.ndarray], depth: int, buckets: int) -> pa.RecordBatch:
    return _arrow(COUNTS, [{"bucket": b, "grams": pack(gram[0][at]), "gram_n": _planes(gram[1][at])} for b, at in _dealt(bucket_of(gram[0], depth, buckets))])


def _shorter(batches: Iterator[pa.RecordBatch], depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of the grams with a context of `depth` bytes from those with longer ones."""
    gathered = _Gathered()
    for batch in batches:
        for keys, n in zip(batch.column("grams").to_pylist(), batch.column("gram_n").to_pylist(), strict=True):
            if gathered.add(*_summed(unpack(keys) & _mask(depth), counts_of(n))):
                yield _sent(gathered.merged(), depth, buckets)
                gathered = _Gathered()
    yield _sent(gathered.merged(), depth, buckets)


# Looking up ----------------------------------------------------------------------------------------------------------


@dataclass
class Open:
    """Grams that are still to be coded: who asks, the log10 probability of the escapes so far, and the symbols excluded, 64 a column."""

    grp: np.ndarray
    key: np.ndarray
    code: np.ndarray
    gone: np.ndarray

    @classmethod
    def new(cls, grp: np.ndarray, key: np.ndarray) -> Open:
        return cls(grp, key, np.zeros(len(key)), np.zeros((len(key), 4), np.uint64))

    def __len__(self) -> int:
        return len(self.key)

    def take(self, at: np.ndarray) -> Open:
        return Open(self.grp[at], self.key[at], self.code[at], self.gone[at])

    def packed(self) -> bytes:
        columns = [self.grp.view(np.uint64), self.key, self.code.view(np.uint64), *self.gone.T]
        return zstandard.ZstdCompressor(level=1).compress(np.concatenate(columns).tobytes())

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Open:
        parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint64).reshape(7, -1) for b in blobs]
        x = np.concatenate([np.zeros((7, 0), np.uint64), *parts], axis=1)
        return cls(x[0].view(np.int64), x[1], x[2].view(np.float64), np.ascontiguousarray(x[3:].T))


class Nodes:
    """The counted grams of one depth (or of one bucket of it), by context."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.keys, self.n, self.depth = keys, n, depth
        context = keys >> np.uint64(8)
        self.first = _starts(context)
        self.contexts = context[self.first]
        self.kinds = np.diff(np.append(self.first, len(keys)))
        self.total = np.add.reduceat(n, self.first) if len(keys) else n

    def totals(self) -> np.ndarray:
        """The total of the context of each gram."""
        return np.repeat(self.total, self.kinds)

    def step(self, asked: Open) -> tuple[np.ndarray, Open]:
        """Which grams are found here, and all of them with their codes after this depth."""
        if not len(self.keys) or not len(asked):
            return np.zeros(len(asked), bool), asked
        node = asked.key & _mask(self.depth)
        at, hit = find(self.contexts, node >> np.uint64(8)), find(self.keys, node)
        gone, code = asked.gone.copy(), asked.code.copy()
        known = np.flatnonzero(at >= 0)
        ends = np.cumsum(self.kinds[at[known]])
        low = 0
        while low < len(known):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARED, "right")))
            some = known[low:high]
            kinds = self.kinds[at[some]]
            begin = np.cumsum(kinds) - kinds
            row = np.repeat(np.arange(len(some)), kinds)
            place = np.arange(len(row)) - np.repeat(begin - self.first[at[some]], kinds)
            symbol = (self.keys[place] & np.uint64(255)).astype(np.int64)
            out = (asked.gone[some[row], symbol >> 6] >> (symbol & 63).astype(np.uint64)) & np.uint64(1) > 0
            total = self.total[at[some]] - np.bincount(row, self.n[place] * out, len(some))
            left = kinds - np.bincount(row, out, len(some))
            found = hit[some] >= 0
            open_ = np.where(found, self.n[np.maximum(hit[some], 0)] - 0.5, left / 2)
            code[some] += np.log10(np.where(total > 0, open_ / np.maximum(total, 1), 1.0))
            for part in range(4):
                bits = np.where(symbol >> 6 == part, np.uint64(1) << (symbol & 63).astype(np.uint64), np.uint64(0))
                gone[some, part] |= np.bitwise_or.reduceat(bits, begin)
            low = high
        return hit >= 0, Open(asked.grp, asked.key, code, gone)


ASKS = "bucket int, grp long, grams binary, gram_n binary, words binary, word_n binary"
#: Answers of a bucket have grp, n, total and word_n; those of shorter contexts grp, grams and code; what is passed on has a state; the bucket's own counts have gram_n, tokens and kinds.
ANSWERS = "bucket int, grp long, n binary, total binary, word_n binary, grams binary, code binary, state binary, gram_n binary, tokens long, kinds long"


def _ask_rows(group: int, gram: tuple[np.ndarray, np.ndarray], word: tuple[np.ndarray, np.ndarray], buckets: int) -> list[dict]:
    rows: dict[int, dict] = {}
    for (keys, n), places, names in ((gram, bucket_of(gram[0], ORDER, buckets), ("grams", "gram_n")), (word, (word[0] % np.uint64(buckets)).astype(np.int32), ("words", "word_n"))):
        for bucket, at in _dealt(places):
            rows.setdefault(bucket, {"bucket": bucket, "grp": group}).update({names[0]: pack(keys[at]), names[1]: _planes(n[at])})
    return list(rows.values())


def _asks(texts: pa.Table, buckets: int) -> pa.Table:
    """The distinct words and grams of one group of documents and their counts in training documents, by bucket."""
    gram, word = _Gathered(), _Gathered()
    for batch in pieces(iter(texts.to_batches())):
        words = Words(batch.column("text"), lower=True)
        learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        key, at = grams(words)
        for gathered, values, row in ((gram, key, np.diff(at)), (word, words.hashes, words.counts), (word, np.zeros(len(learn), np.uint64), np.ones(len(learn), int))):
            taught = np.repeat(learn, row)
            gathered.add(*np.unique(values[taught], return_counts=True))
            new = np.unique(values[~taught])
            gathered.add(new, np.zeros(len(new), np.int64))
    return pa.Table.from_batches([_arrow(ASKS, _ask_rows(texts["grp"][0].as_py(), gram.merged(), word.merged(), buckets))])


def _coded(done: Open) -> Iterator[dict]:
    """Answers with codes, a row for each group."""
    order = np.lexsort((done.key, done.grp))
    grp = done.grp[order]
    for low, high in _runs(grp):
        at = order[low:high]
        yield {"grp": int(grp[low]), "grams": pack(done.key[at]), "code": _planes(done.code[at])}


def _passed_on(asked: Open, depth: int, buckets: int) -> Iterator[dict]:
    for bucket, at in _dealt(bucket_of(asked.key, depth, buckets)):
        yield {"bucket": bucket, "state": asked.take(at).packed()}


def _answered(asks: pa.Table, buckets: int) -> pa.Table:
    """What one bucket answers to all groups, the grams that no training document holds, and the counts themselves."""
    columns = {c: asks[c].to_pylist() for c in ("grp", "grams", "words")}
    key, n = _added(asks["grams"], asks["gram_n"])
    nodes = Nodes(key[n > 0], n[n > 0], ORDER)
    word, word_n = _added(asks["words"], asks["word_n"])
    rows: list[dict] = [{"grams": pack(nodes.keys), "gram_n": _planes(nodes.n), "tokens": int(word_n.sum()), "kinds": int((word_n > 0).sum())}]
    missed = []
    for group, gram, words in zip(columns["grp"], columns["grams"], columns["words"], strict=True):
        asked = unpack(gram)
        at = find(nodes.keys, asked)
        met = np.maximum(at, 0)
        n, total = (np.where(at >= 0, x[met], 0) if len(nodes.keys) else np.zeros(len(at), np.int64) for x in (nodes.n, nodes.totals()))
        rows.append({"bucket": asks["bucket"][0].as_py(), "grp": group, "n": _planes(n), "total": _planes(total), "word_n": _planes(word_n[find(word, unpack(words))]) if words else None})
        missed.append(Open.new(np.full((at < 0).sum(), group, np.int64), asked[at < 0]))
    missed = Open(*(np.concatenate([getattr(m, c) for m in missed]) for c in ("grp", "key", "code", "gone")))
    rows += _passed_on(nodes.step(missed)[1], ORDER - 1, buckets)
    return pa.Table.from_batches([_arrow(ANSWERS, rows)])


def _deeper(counted: pa.Table, states: pa.Table, depth: int, buckets: int) -> pa.Table:
    """The same for grams that have escaped to this depth."""
    if not states.num_rows:
        return pa.Table.from_batches([_arrow(ANSWERS, [])])
    own = counted.to_pylist()[0] if counted.num_rows else {}
    found, asked = Nodes(unpack(own.get("grams")), counts_of(own.get("gram_n")), depth).step(Open.unpacked(states["state"].to_pylist()))
    rows = [*_coded(asked.take(np.flatnonzero(found))), *_passed_on(asked.take(np.flatnonzero(~found)), depth - 1, buckets)]
    return pa.Table.from_batches([_arrow(ANSWERS, rows)])


def _at_depth(depth: int, buckets: int):
    return lambda counted, states: _deeper(counted, states, depth, buckets)


def _last(batches: Iterator[pa.RecordBatch], shallow: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Codes of the grams that have escaped to the broadcast nodes; in the end all symbols that are left are equally likely."""
    for batch in batches:
        for state in batch.column("state").to_pylist():
            asked, rows = Open.unpacked([state]), []
            for depth in range(SHALLOW, -1, -1):
                key, n = _summed(shallow[0] & _mask(depth), shallow[1])
                found, asked = Nodes(key, n, depth).step(asked)
                rows += _coded(asked.take(np.flatnonzero(found)))
                asked = asked.take(np.flatnonzero(~found))
            left = 256 - np.bitwise_count(asked.gone).sum(axis=1)
            rows += _coded(replace(asked, code=asked.code - np.log10(np.maximum(left, 1))))
            yield _arrow(ANSWERS, rows)


class Trie:
    """Counts by depth: written tables of packed runs from ORDER down to SHALLOW + 1, and the nodes of SHALLOW bytes of context in memory."""

    def __init__(self, counted: DataFrame, buckets: int):
        """counted: (grams, gram_n) of ORDER bytes of context, a written table."""
        self.nodes, self.buckets = {ORDER: counted}, buckets
        for m in range(ORDER - 1, SHALLOW, -1):
            self.nodes[m] = saved(self._from(m, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merged, COUNTS))
        rows = self._from(SHALLOW, 1).toArrow()
        self.shallow = _added(rows["grams"], rows["gram_n"])

    def _from(self, depth: int, buckets: int) -> DataFrame:
        longer = self.nodes[depth + 1].select("grams", "gram_n")
        if depth == SHALLOW:  # few tasks, so the driver gets few parts of 2**16 nodes at most
            longer = longer.coalesce(32)
        return longer.mapInArrow(lambda b: _shorter(b, depth, buckets), COUNTS)

    def escaped(self, met: DataFrame) -> DataFrame:
        """(grp, grams, code) of what a written table of ANSWERS passes on."""
        buckets = self.buckets
        shared = met.sparkSession.sparkContext.broadcast(self.shallow)
        told = []
        for m in range(ORDER - 1, SHALLOW, -1):
            left = met.where("state is not null").select("bucket", "state").repartition(buckets, "bucket")
            met = saved(self.nodes[m].groupBy("bucket").cogroup(left.groupBy("bucket")).applyInArrow(_at_depth(m, buckets), ANSWERS))
            told.append(met.where("grp is not null").select("grp", "grams", "code"))
        out = met.where("state is not null").select("state").mapInArrow(lambda b: _last(b, shared.value), ANSWERS).select("grp", "grams", "code")
        for rows in told:
            out = out.unionByName(rows)
        return out

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the bytes before it; for a few grams."""
        wanted, inverse = np.unique(keys, return_inverse=True)
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows = _ask_rows(0, (wanted, np.zeros(len(wanted), np.int64)), none, self.buckets)
        asked = self.nodes[ORDER].sparkSession.createDataFrame([(r["bucket"], 0, r["grams"], r["gram_n"], None, None) for r in rows], ASKS)
        buckets = self.buckets
        again = self.nodes[ORDER].mapInArrow(lambda b: _shorter(b, ORDER, buckets), COUNTS)
        met = answered(asked.unionByName(again.withColumn("grp", F.lit(-1).cast("long")), allowMissingColumns=True), self.buckets)
        got = met.where("grp = 0").select("bucket", "n", "total", F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("code"))
        return _codes(got.unionByName(self.escaped(met).where("grp = 0"), allowMissingColumns=True).toArrow(), wanted, self.buckets)[inverse]


def answered(asks: DataFrame, buckets: int) -> DataFrame:
    """ANSWERS to ASKS, written."""
    return saved(asks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _answered(t, buckets), ANSWERS))


def train(docs: DataFrame, buckets: int = 8) -> Trie:
    """The trie of the texts of docs, in so many buckets."""
    rows = docs.select("text", F.lit(False).alias("held_out"), F.pmod(F.xxhash64("text"), F.lit(buckets)).alias("grp"))
    met = answered(rows.groupBy("grp").applyInArrow(lambda t: _asks(t, buckets), ASKS), buckets)
    return Trie(met.where("gram_n is not null").select("grams", "gram_n"), buckets)


# Scores --------------------------------------------------------------------------------------------------------------


def _codes(answers: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """log10 probabilities of a group's grams, in the order in which it asked."""
    out = np.zeros(len(keys))
    asked = dict(_dealt(bucket_of(keys, ORDER, buckets)))
    bucket, n, total, gram, code = (answers[c].to_pylist() for c in ("bucket", "n", "total", "grams", "code"))
    for i in range(answers.num_rows):
        if code[i]:
            out[find(keys, unpack(gram[i]))] = _from_planes(code[i]).view(np.float64)
        elif bucket[i] in asked:
            count = counts_of(n[i])
            known = count > 0
            out[asked[bucket[i]][known]] = np.log10((count[known] - 0.5) / counts_of(total[i])[known])
    return out


def _scored(texts: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    held, gram, word = [], _Gathered(), _Gathered()
    for batch in pieces(iter(texts.combine_chunks().to_batches())):
        words = Words(batch.column("text"), lower=True)
        key, at = grams(words)
        inverse, distinct = pd.factorize(key)
        order = np.argsort(distinct)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        known, place = np.unique(words.hashes, return_inverse=True)
        gram.add(distinct[order], np.zeros(len(order), np.int64))
        word.add(known, np.zeros(len(known), np.int64))
        held.append((batch, words.at, at, distinct[order], back[inverse], known, place.astype(np.int32)))
    word.add(np.zeros(1, np.uint64), np.zeros(1, np.int64))
    keys, marks = gram.merged()[0], word.merged()[0]
    code, n = _codes(answers, keys, buckets), np.zeros(len(marks), np.int64)
    asked = dict(_dealt((marks % np.uint64(buckets)).astype(np.int32)))
    for bucket, told in zip(answers["bucket"].to_pylist(), answers["word_n"].to_pylist(), strict=True):
        if told:
            n[asked[bucket]] = counts_of(told)
    end = n[0]
    out = []
    for batch, row, at, distinct, inverse, known, place in held:
        c = n[np.searchsorted(marks, known)][place]
        logs = np.concatenate([[0.0], np.cumsum(np.log10(c + 0.1))])
        met = np.concatenate([[0], np.cumsum(c > 0)])
        bits = code[np.searchsorted(keys, distinct)][inverse]
        out.append(
            pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("held_out"), pa.array(np.diff(row) + 1, pa.int64()), pa.array(met[row[1:]] - met[row[:-1]] + int(end > 0), pa.int64()), pa.array(logs[row[1:]] - logs[row[:-1]] + np.log10(end + 0.1)), pa.array(np.add.reduceat(bits, at[:-1]))],
                names=["key", "held_out", "n_tokens", "n_known", "logs", "score"],
            )
        )
    return pa.Table.from_batches(out)


def language_scores(docs: DataFrame, held_out: F.Column, *, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; models learn from rows where held_out is false."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups, buckets = max(1, -(-size // group_bytes)), max(1, -(-size // BUCKET_BYTES))
    source = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    dealt = source.withColumn("grp", F.pmod(F.xxhash64("key", "text"), F.lit(groups))).repartition(groups, "grp")
    met = answered(dealt.select("text", "held_out", "grp").groupBy("grp").applyInArrow(lambda t: _asks(t, buckets), ASKS), buckets)
    tokens, kinds = met.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    trie = Trie(met.where("gram_n is not null").select("grams", "gram_n"), buckets)
    answers = met.where("grp is not null").select("grp", "bucket", "n", "total", "word_n").unionByName(trie.escaped(met), allowMissingColumns=True)
    kind = docs.schema[key].dataType.simpleString()
    out = dealt.groupBy("grp").cogroup(answers.repartition(groups, "grp").groupBy("grp")).applyInArrow(lambda a, b: _scored(a, b, buckets), f"key {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double")
    out = out.withColumn("train_tokens", F.lit(tokens).cast("long"))
    base = F.col("logs") - F.col("n_tokens") * math.log10(tokens + 0.1 * (kinds + 1))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), F.expr("crc32(cast(doc_id as string)) % 10 = 0"))
