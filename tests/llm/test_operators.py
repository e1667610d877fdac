"""Operators against brute force, and their edge cases: nulls, empty and long texts, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontamination, html_extraction, jaccard_join, language_model, privacy, quality, quality_rules, sentencepiece_codec, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(50))
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + "\n" + shared, shared + "  \t" + texts[3], "a " * 200]
    near = texts[5].split()
    texts += [" ".join(near[:70] + ["zz"] + near[71:]), None, "", " \n ", "one", "x" * 5000]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", None, "clash") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, key string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_substring_dedup(docs, none):
    words = {i: WORD.findall(t or "") for i, t in corpus()}
    seen = Counter(tuple(w[p : p + 35]) for w in words.values() for p in range(len(w) - 34))
    for row in substring_dedup.remove_repeats(docs).collect():
        w = words[row.doc_id]
        gone = {q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        assert (row.n_words, row.n_removed, row.kept) == (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_jaccard(docs, none):
    sets = {}
    for i, t in corpus():
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[p : p + 3]) for p in range(len(w) - 2)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert jaccard_join.jaccard_components(none).count() == 0
    assert jaccard_join.keep_one(docs).count() == len({root(i) for i in sets})


def test_decontamination(spark, docs, none):
    rows = corpus()
    items = [(1, " ".join(rows[4][1].split()[:30])), (2, "one"), (3, None), (4, "??"), (5, rows[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = alnum.findall(lower(t or ""))
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    for blocks in (32_000_000, 100):
        got = {r.doc_id: r for r in decontamination.contamination(docs, bench, block_chars=blocks).collect()}
        for i, t in rows:
            w = alnum.findall(lower(t or ""))
            hits, found = set(), set()
            for n in {len(k) for k in windows}:
                for p in range(len(w) - n + 1):
                    if owners := windows.get(tuple(w[p : p + n])):
                        found |= owners
                        hits |= set(range(p, p + n))
            assert (got[i].n_words, got[i].hits, got[i].items) == (len(w), sorted(hits), sorted(found))
    kept = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench).collect()}
    assert kept[7] == rows[7][1] and 6 not in kept
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs, bench.where("false")).where("size(hits) > 0").count() == 0


def test_language_model(docs, none):
    out = F.expr("doc_id % 10 = 0")
    words = {i: [*WORD.findall(lower(t or "")), None] for i, t in corpus()}
    count = Counter(x for i, w in words.items() if i % 10 for x in w)
    n, v = sum(count.values()), len(count)
    for r in language_model.language_scores(docs, out, group_bytes=2000).collect():
        w = words[r.doc_id]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert language_model.language_scores(none, out).count() == 0


def test_model_probabilities_sum_to_one(spark, docs):
    import numpy as np

    trie = language_model.train(docs.where("doc_id < 30"))
    for context in (b"\n\n\n\n\n", b"a b c", b"zzzzz", b"abcde"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert abs((10 ** trie.log10(keys)).sum() - 1) < 1e-9


def test_privacy(spark, docs, none):
    text = "mail Ab.c@x-y.org, +49 (30) 123 456-78 or 192.168.0.1 300.1.1.1 card 4111 1111-1111 1111 and 4111111111111112"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: [(privacy.KINDS[s.rank], text[s.start : s.stop]) for s in r.spans] for r in privacy.personal_spans(df).collect()}
    assert got == {1: [("email", "Ab.c@x-y.org"), ("phone", "+49 (30) 123 456-78"), ("ip", "192.168.0.1"), ("card", "4111 1111-1111 1111")], 2: [], 3: []}
    assert privacy.personal_spans(none).count() == 0
    long = spark.createDataFrame([(1, "1 " * 40000 + "a" * 60000 + "9" * 60000)], "doc_id long, text string")
    assert privacy.personal_spans(long).first().spans == []


def test_terms_that_disclose(spark):
    rows = ["Contact Zorblatt Quimby at zq@x.org now", "see Zorblatt under zq@x.org please", "nothing here"] + [f"some other text {i} with words at m{i}@x.org now" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r.text for r in privacy.sanitise(df).orderBy("doc_id").collect()]
    assert got[:4] == ["Contact [TERM] Quimby at [EMAIL] now", "see [TERM] under [EMAIL] please", "nothing here", "some other text 0 with words at [EMAIL] now"]


def test_rules(docs, none):
    for r in quality_rules.judged(docs).collect():
        t = dict(corpus())[r.doc_id] or ""
        w = WORD.findall(t)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {q for p in range(len(w) - 2) if seen[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert r.base_failed == (len(w) < 50 or 2 * len(again) > len(w)) and (not r.kept or not r.base_failed)
    assert quality_rules.judged(none).count() == 0


def test_html():
    page = "<body><nav><a>m</a></nav><div class=ad>x<article><h1>T</h1><p>One &amp; two<br>three<p>Four <b>five</b><div class=comments>c</div></article><footer>f</footer>"
    assert html_extraction.main_text(page) == "T\nOne & two three\nFour five"
    assert html_extraction.main_text(None) == html_extraction.main_text("<p>") == ""


def test_tokens(spark, docs, none):
    rows = {r.doc_id: r for r in sentencepiece_codec.encode(docs).collect()}
    assert rows[67 + 0].ids is None or rows[67].text is not None
    back = {r.doc_id: r.decoded for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect()}
    assert back == dict(corpus())
    coder = sentencepiece_codec.codec(sentencepiece_codec._read(sentencepiece_codec.model_path()))
    assert coder.verify([t for _, t in corpus() if t is not None]) == []
    assert sentencepiece_codec.encode(none).count() == 0


def test_classifiers_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels, F.lit(True))
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs.select("doc_id", "text"), field).collect()}
    assert set(scores.values()) == {0.0, 0.5}
    machine = toxicity.train(docs, labels, F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.toxicity_scores(docs, machine).collect())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for op, name, least in ((quality.op2_quality_classifier, "quality", 0.97), (toxicity.op3_toxicity, "toxic", 0.93)):
        held = [r for r in op(spark, folder).collect() if r.held_out and r.doc_id in labels]
        assert sum(r.predicted == labels[r.doc_id][name] for r in held) >= least * len(held)


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) and all(r.n_tokens == len(r.input_ids) for r in rows)


def test_digest_of_items(spark):
    got = decontamination.op9_benchmark_decontamination(spark, "/root/testdata/sf0.001")
    clean = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == clean) == (r.n_items == 0) for r in got.collect())


def test_op4_digests_build_no_arrow_lists_of_ids(monkeypatch):
    import pyarrow as pa

    from graphloom.llm import sentencepiece_codec as codec

    data = codec._read(codec.model_path())
    texts = ["Plain  words", None, "", "数字 🙂", " lead"]
    batch = pa.RecordBatch.from_pydict({"key": list(range(5)), "text": pa.array(texts, pa.string())})
    whole = pa.Table.from_batches(list(codec._encoded(iter([batch]), data))).column("ids").to_pylist()
    monkeypatch.setattr(codec, "_encoded", None)
    got = pa.Table.from_batches(list(codec._digests(iter([batch]), data)))
    assert got.column("n_tokens").to_pylist() == [len(i or ()) for i in whole]
    coder = codec.codec(data)
    unknown = coder.model.unknown
    for odd in ([], [None], [-1, 300, 10**9], [300, None, 301]):
        assert coder.decode(odd) == coder.decode([i if i is not None and 0 <= i < len(coder.spell) else unknown for i in odd])
