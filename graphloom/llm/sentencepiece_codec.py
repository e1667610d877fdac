"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is read here, field by field: pieces with scores and types, the trainer's kind, and the
normaliser's settings. From them a tokenizers pipeline is rebuilt: the normaliser (its compiled character map, if any,
extra white space, dummy prefix), the metaspace marker, the pieces (unigram scores, or BPE merges in score order)
and byte fallback. Batches are encoded by the library's threads. Where no piece holds a marker after another
character, texts are cut before each run of markers, which changes no result and lets the library's word cache work.

Parity is verified: `verify` compares ids with the sentencepiece library on texts that use every feature, when an
encoder is built, and `parity` does so for a whole table. Decoding joins pieces and bytes, and drops the dummy prefix.

Edges: null gives a null list of ids, the empty text an empty list; decoding takes ids that the model lacks, negative and null ones too, for the unknown piece;
repeated rows encode alike; very long texts are encoded whole, one at a time; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import pieces

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The model file; a parameter of every function here.
DEFAULT_MODEL = "piece_bpe_32k.model"


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message: varints, 32- and 64-bit values as bytes, and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    dummy_prefix: bool = True
    dummy_suffix: bool = False
    extra_spaces: bool = True  # are removed
    escape: bool = True
    charmap: bytes = b""

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in wire(data):
            if number == 1:
                piece = {k: v for k, v in wire(value)}
                score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                out.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = {k: v for k, v in wire(value)}
                out.kind, out.byte_fallback, out.unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
                out.dummy_suffix = bool(trainer.get(24, 0))
            elif number == 3:
                norm = {k: v for k, v in wire(value)}
                out.charmap, out.dummy_prefix, out.extra_spaces, out.escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        if out.dummy_suffix or not out.escape or out.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with escaped white space and without a suffix marker are supported")
        return out

    def cuts(self) -> bool:
        """Whether cutting before runs of markers is free of effect."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


class Codec:
    """Encodes and decodes; built anew in each process, as the library's objects don't travel."""

    def __init__(self, data: bytes):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.data, self.model = data, (m := Model.parse(data))
        vocabulary = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        if m.kind == BPE:
            usable = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
            merges = []
            for piece, score in usable.items():
                parts = [(-score, vocabulary[piece], piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
                merges += sorted(parts, key=lambda x: (vocabulary[x[2]], vocabulary[x[3]]))
            merges.sort(key=lambda x: (x[0], x[1]))
            inner = models.BPE(vocabulary, [(a, b) for _, _, a, b in merges], unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            # Only normal and user-defined pieces may match a text: no text holds a space once it is a marker, and bytes score below any run of pieces.
            floor = min((s for _, s, kind in m.pieces if kind in (NORMAL, USER)), default=0.0) - 1000
            spelled = lambda p, s, kind: (p, s) if kind in (NORMAL, USER) else (p, floor) if kind == BYTE else (f" {p}", 0.0)
            inner = models.Unigram([spelled(*piece) for piece in m.pieces], unk_id=m.unknown, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(inner)
        steps = [normalizers.Precompiled(m.charmap)] if m.charmap else []
        if m.extra_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Replace(" ", MARK)] + ([normalizers.Prepend(MARK)] if m.dummy_prefix else [])
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        splits = [pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")] if m.cuts() else []
        if m.kind == UNIGRAM and not any("<" in p for p, _, kind in m.pieces if kind in (NORMAL, USER)):
            splits.append(pre_tokenizers.Split("<", "isolated"))  # so that the names of byte pieces match no text
        if splits:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(splits)
        self.tokenizer.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " ")])
        # Pieces decode to themselves; controls to nothing, the unknown piece to its mark.
        self.spell = [
            {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in m.pieces
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        if None in ids or (len(ids) and not 0 <= min(ids) <= max(ids) < len(self.spell)):
            ids = [i if i is not None and 0 <= i < len(self.spell) else self.model.unknown for i in ids]
        raw = b"".join(map(self.spell.__getitem__, ids))
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def verify(self, texts: list[str]) -> list[int]:
        """Numbers of the texts whose ids differ from the sentencepiece library's."""
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return [i for i, (a, b) in enumerate(zip(self.encode(texts), other.encode(texts, num_threads=1), strict=True)) if a != b]


PROBES = ["", " ", "a", "Plain words, and  two spaces   three.", "line\nnext\ttab \r\n", "ÄÖü ß é ñ ç", "数字 かな 한글 🙂🙃", "▁ marker ▁▁x", "ﬁ ①   nbsp ​", "x" * 300, "http://a.example/b?c=1&d=2", "  lead and trail  ", "\x00\x01 control", "1234567890 3.14 -5", "<s> </s> <unk> <0x41>"]
_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """The process's codec for the model, verified once."""
    key = hash(data)
    if key not in _codecs:
        made = Codec(data)
        if wrong := made.verify(PROBES):
            raise ValueError(f"ids differ from the sentencepiece library's on {[PROBES[i] for i in wrong]!r}")
        _codecs[key] = made
    return _codecs[key]


def _encoded(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[pa.RecordBatch]:
    coder = codec(data)
    for batch in pieces(batches):
        texts = batch.column("text").to_pylist()
        ids = iter(coder.encode([t for t in texts if t is not None]))
        yield batch.append_column("ids", pa.array([None if t is None else next(ids) for t in texts], pa.list_(pa.int32())))


def _decoded(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[pa.RecordBatch]:
    coder = codec(data)
    for batch in batches:
        yield batch.append_column("decoded", pa.array([None if i is None else coder.decode(i) for i in batch.column("ids").to_pylist()], pa.string()))


def _digests(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[pa.RecordBatch]:
    import hashlib

    coder = codec(data)
    for batch in pieces(batches):
        texts = batch.column("text").to_pylist()
        made = iter(coder.encode([t for t in texts if t is not None]))
        ids = [None if t is None else next(made) for t in texts]
        back = [None if i is None else coder.decode(i) for i in ids]
        digest = lambda x: None if x is None else hashlib.sha256(x).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                pa.array([len(i or ()) for i in ids], pa.int64()),
                pa.array([digest(None if i is None else np.array(i, "<i4").tobytes()) for i in ids], pa.string()),
                pa.array([digest(None if b is None else b.encode()) for b in back], pa.string()),
                pa.array([b == t for b, t in zip(back, texts, strict=True)], pa.bool_()),
            ],
            names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
        )


def _read(model: str) -> bytes:
    with open(model, "rb") as f:  # on the driver; its bytes (under a MB) travel to the executors
        return f.read()


def encode(docs: DataFrame, *, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, ids array<int>)."""
    data = docs.sparkSession.sparkContext.broadcast(_read(model or model_path()))
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lambda b: _encoded(b, data.value), f"key {kind}, text string, ids array<int>")
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "ids")


def decode(encoded: DataFrame, *, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded string)."""
    data = encoded.sparkSession.sparkContext.broadcast(_read(model or model_path()))
    kind = encoded.schema[key].dataType.simpleString()
    out = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(lambda b: _decoded(b, data.value), f"key {kind}, ids array<int>, decoded string")
    return out.select(F.col("key").alias(key), F.col("ids").alias(ids), "decoded")


def _unequal(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[pa.RecordBatch]:
    coder = codec(data)
    for batch in pieces(batches):
        some = batch.filter(batch.column("text").is_valid())
        wrong = coder.verify(some.column("text").to_pylist()) if some.num_rows else []
        yield some.take(pa.array(wrong, pa.int64()))


def parity(docs: DataFrame, *, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of the rows whose ids differ from the sentencepiece library's: none, if all is well."""
    data = docs.sparkSession.sparkContext.broadcast(_read(model or model_path()))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = source.mapInArrow(lambda b: _unequal(b, data.value), source.schema)
    return out.select(F.col("key").alias(key), F.col("text").alias(text))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every text (their number and digest) and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    data = spark.sparkContext.broadcast(_read(model_path()))
    kind = docs.schema["key"].dataType.simpleString()
    out = docs.mapInArrow(lambda b: _digests(b, data.value), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    return out.withColumnRenamed("key", "doc_id")
