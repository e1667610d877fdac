"""Cases that once crashed or were not defined, and brute force over whole tables."""

import math
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join, language_model, privacy, quality, quality_rules, sentencepiece_codec, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def whole(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_scores_with_clashing_names(spark):
    rows = [(1, "a good text of words", 7.0, "k"), (1, "a good text of words", 7.0, "k"), (2, None, None, None), (3, "", 1.0, "")]
    df = spark.createDataFrame(rows, "doc_id long, body string, score double, text string")
    field = quality.Field()
    got = quality.quality_scores(df, field, text="body")
    assert got.columns == ["doc_id", "body", "text", "score"]
    assert sorted((r.doc_id, r.text, r.score) for r in got.collect() if r.text is not None) == [(1, "k", 0.5), (1, "k", 0.5), (3, "", 0.0)]
    assert quality.quality_scores(df.where("false"), field, text="body").count() == 0
    got = toxicity.toxicity_scores(df, toxicity.Machine(), text="body").collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert toxicity.toxicity_scores(df.where("false"), toxicity.Machine(), text="body").count() == 0


def test_very_long_texts(spark):
    text = "word another thing\n" * 60_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(df, quality.Field()).collect())
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(df, toxicity.Machine()).collect())
    assert {r.doc_id: r.decoded for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df)).collect()} == {1: text, 2: "short"}
    assert {r.doc_id: r.n_shingles for r in jaccard_join.jaccard_components(df).collect()} == {1: 3, 2: 1}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()} == {1: (180_000, 180_000), 2: (1, 0)}
    got = {r.doc_id: r for r in quality_rules.judged(df.withColumns({"lang": F.lit("en"), "source": F.lit("s")})).collect()}
    assert (got[1].n_words, got[1].n_dup_lines, got[1].n_repeat_words) == (180_000, 59_999, 180_000)
    scored = {r.doc_id: r for r in language_model.language_scores(df, F.expr("doc_id = 2"), group_bytes=1000).collect()}
    assert scored[1].n_tokens == 180_001 and scored[2].held_out


def test_ids_that_the_model_lacks(spark):
    df = spark.createDataFrame([(1, [-1, 10**6, None]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in sentencepiece_codec.decode(df).collect()}
    assert got[1].count("⁇") == 3 and got[2] == "" and got[3] is None


def _message(*fields):
    """Protobuf bytes of (number, value): whole numbers as varints, floats as 32 bits, the rest by length."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_models_encode_as_the_library_does(whole):
    """A model written by hand: pieces of the texts' letters, syllables and words, with byte fallback."""
    texts = [t for t in whole.values() if t][:150]
    words = Counter(w for t in texts for w in t.split(" ") if w and len(w) < 9 and w.isalpha())
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    known = ["▁" + w for w, _ in words.most_common(150)] + sorted({w[i : i + 2] for w in words for i in range(len(w) - 1)})[:300] + sorted({c for w in words for c in w}) + ["▁"]
    pieces += [(p, -2.0 - zlib.crc32(p.encode()) / 2**29, 1) for i, p in enumerate(dict.fromkeys(known))]
    proto = _message(*((1, _message((1, p), (2, s), (3, k))) for p, s, k in pieces), (2, _message((3, 1), (35, 1))), (3, _message((1, "identity"), (3, 1), (4, 1), (5, 1))))
    coder = sentencepiece_codec.Codec(proto)
    assert coder.verify(texts + sentencepiece_codec.PROBES) == []
    assert all(coder.decode(i) == " ".join(x for x in t.split(" ") if x) for t, i in zip(texts, coder.encode(texts), strict=True))


def test_parity_of_a_whole_table(spark):
    assert sentencepiece_codec.parity(spark.read.parquet(f"{DATA}/documents.parquet")).count() == 0


def base_spans(text):
    """The contract's patterns, plainly."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]

    def luhn(d):
        return sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_of_a_whole_table(spark, whole):
    for r in privacy.personal_spans(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        assert [(s.start, s.rank, s.stop) for s in r.spans if s.rank < 4] == base_spans(whole[r.doc_id] or "")


def test_many_addresses_in_one_text(spark):
    text = " ".join(f"mail a{i}@x{i}.org or 10.0.{i % 256}.1" for i in range(3_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = privacy.sanitise(df).first()
    assert row.text == " ".join(["mail [EMAIL] or [IP]"] * 3_000)
    assert time.time() - began < 60


def test_rules_of_a_whole_table(spark, whole):
    got = {r.doc_id: r for r in quality_rules.judged(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    for i, t in whole.items():
        t, r = t or "", got[i]
        w = WORD.findall(t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {q for p in range(len(w) - 2) if seen[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)}
        lines = Counter(x for x in t.split("\n") if WORD.search(x))
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(n - 1 for n in lines.values()), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and (not r.kept or not r.base_failed)


def test_base_scores_of_a_whole_table(spark, whole):
    lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    rows = language_model.op5_lm_scoring(spark, DATA).collect()
    words = {i: [*WORD.findall(lower(t or "")), None] for i, t in whole.items()}
    count = Counter(x for r in rows if not r.held_out for x in words[r.doc_id])
    n, v = sum(count.values()), len(count)
    for r in rows:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, an extra column of a clashing name, and empty tables."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
    good = " ".join(f"plain{i} words" for i in range(80))
    rows = [(1, good, "en", "s", 5, 0.1, "k"), (1, good, "en", "s", 5, 0.1, "k"), (2, None, None, None, None, None, None), (None, good + " x", None, "s", 1, None, ""), (3, "", "en", "s", 0, None, ""), (4, "mail me at a@b.org " + good, "en", "s", 9, None, "")]
    docs = spark.createDataFrame(rows, schema)
    for name, table, count in (("some", docs, 3), ("none", docs.where("false"), 0)):
        folder = tmp_path / name
        table.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([("b1", " ".join(f"plain{i}" for i in range(5)))], "item_id string, text string").write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert all(r.n_tokens == len(r.input_ids or ()) for r in out) and (len(out) > 0) == (count > 0)
