"""Small cases in which an operator once did less than its whole job."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import html_extraction, jaccard_join, language_model, privacy, quality, quality_rules


def test_language_model_keeps_rare_grams_on_large_inputs(spark):
    """The same text after the same evidence has the same score, however much other text there is."""
    rare = "quick vixens jumped over mighty dwarfs"
    scores = []
    for times in (1000, 1_500_000):
        df = spark.createDataFrame([(1, rare), (2, "ab " * times), (10, rare)], "doc_id long, text string")
        rows = language_model.language_scores(df, F.expr("doc_id % 10 = 0")).collect()
        scores.append(next(r.score for r in rows if r.doc_id == 10))
    assert abs(scores[0] - scores[1]) < 1e-9


def test_language_model_is_ppm_d_of_seven_bytes(spark):
    texts = {1: "the cat sat on the mat", 2: "the dog sat on the log and the cat ran", 3: None, 10: "the cow sat on a zebra", 20: "", 30: "the cat sat"}
    order = 7
    seen = defaultdict(Counter)
    line = lambda t: b"\n" * order + (t or "").encode() + b"\n"
    for i, t in texts.items():
        if i % 10:
            b = line(t)
            for p in range(order, len(b)):
                for m in range(order + 1):
                    seen[b[p - m : p]][b[p]] += 1

    def code(context, symbol):
        out, gone = 0.0, set()
        for m in range(order, -1, -1):
            c = {s: n for s, n in seen[context[order - m :]].items() if s not in gone}
            if symbol in c:
                return out + math.log10((c[symbol] - 0.5) / sum(c.values()))
            if c:
                out += math.log10(len(c) / 2 / sum(c.values()))
            gone |= set(c)
        return out - math.log10(256 - len(gone))

    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in language_model.language_scores(df, F.expr("doc_id % 10 = 0"), group_bytes=30).collect():
        b = line(texts[r.doc_id])
        assert abs(r.score - sum(code(b[p - order : p], b[p]) for p in range(order, len(b)))) < 1e-9


def test_pipeline_drops_near_duplicates_of_five_words(spark):
    """Copies between the pipeline's thresholds (five words, 0.8) and those of op8 (three words, 0.9)."""
    import corpus_pipeline

    texts = []
    for k, size in enumerate((49, 55, 58)):
        words = [f"w{k}x{i}" for i in range(size)]
        texts += [" ".join(words), " ".join([*words[:25], "other", *words[26:]])]
    words = [f"long{i}" for i in range(500)]
    texts += [" ".join(words), " ".join("other" if i % 50 == 25 else w for i, w in enumerate(words)), "some text that stands alone among these documents"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()) == [0, 2, 4, 6, 8]


def test_rules_judge_small_groups(spark):
    """A rare language's or source's documents are judged as well, by what is usual elsewhere."""
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 300)))
    junk = " ".join("#$%&|<>*" + "".join(rng.choice("ABCDEFGH*#$") for _ in range(20)) for _ in range(100))
    rows = [(i, prose(), "en", "big") for i in range(200)]
    rows += [(200, junk, "en", "big"), (201, junk, "xx", "one"), (202, junk, None, None), (203, junk, "en", "small"), (204, prose(), "yy", "one"), (205, prose(), None, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    assert all(r.d2 is not None and not r.base_failed for r in got.values())
    assert [got[i].kept for i in range(200, 206)] == [False, False, False, False, True, True]
    assert sum(got[i].kept for i in range(200)) >= 198


def test_html_of_divs_only():
    """Without an article or main nothing of the content's region is dropped but boilerplate."""
    long, short, quote = "long words " * 180, "short words " * 25, "a quote " * 8
    join = lambda *parts: "\n".join(" ".join(p.split()) for p in parts)
    page = f"<body><div class=nav><a>m</a></div><div><div>{long}</div><div>{short}</div></div><div class=footer>f</div></body>"
    assert html_extraction.main_text(page) == join(long, short)
    page = f"<html><body><div id=wrap><h1>T</h1><div><p>{long}</p><blockquote>{quote}</blockquote></div><div>{quote}</div><div class=comments>{short}</div></div></body></html>"
    assert html_extraction.main_text(page) == join("T", long, quote, quote)
    assert html_extraction.main_text(f"<div>{long}</div><div>x</div><div>y</div><div>{quote}</div>") == join(long, "x", "y", quote)


def test_quality_classifier_learns_from_all_lines():
    """Junk after many good lines reaches the training rows."""
    texts = ["\n".join(f"line {i} of a good text" for i in range(100)) + "\n$$$ |||| BUY", "one line", "", None]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 1, 1], pa.int32()), pa.array(texts)], names=["label", "text"])
    rows = pa.Table.from_batches(quality._features(iter([batch]))).to_pylist()
    assert [len(r["size"]) for r in rows] == [101, 1, 0, 0]
    assert all(len(r["features"]) == quality.WIDTH * len(r["size"]) for r in rows)


def test_terms_beside_an_entity_seen_once(spark):
    """Disclosing terms need no second context, no short words around them, and go from documents without the entity too."""
    far = " ".join(f"{'verylongword' * 4}{c}" for c in "abcde")
    rows = ["Zorblatt lives at solo@y.org", "we met zorblatt there", f"Quimby {far} far@y.org"]
    rows += [f"we met others there and one lives at m{i}@x.org and {far}" for i in range(1100)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r.text for r in privacy.sanitise(df).orderBy("doc_id").collect()]
    assert got[:4] == ["[TERM] lives at [EMAIL]", "we met [TERM] there", f"[TERM] {far} [EMAIL]", f"we met others there and one lives at [EMAIL] and {far}"]


def test_jaccard_of_any_ids_and_of_large_lists(spark, monkeypatch):
    """Ids that aren't numbers, equal ids with different texts, and posting lists of more members than one task compares."""
    monkeypatch.setattr(jaccard_join, "LIST", 3)
    body = " ".join(f"w{i}" for i in range(60))
    rows = [("b", body), ("a", body + " x"), ("b", "some other text"), ("c", "some other text"), (None, body), ("d", None), ("e", ""), ("f", "one")]
    rows += [(f"g{i}", " ".join([*(f"w{j}" for j in range(30)), *(f"u{i}x{j}" for j in range(30))])) for i in range(12)]
    rows += [(f"h{i}", f"{rows[8 + i][1]} more") for i in range(12)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id string, text string, n int, doc int")
    got = sorted(((r.doc_id or "", r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    want = [("b", 58, "a"), ("a", 59, "a"), ("b", 1, "b"), ("c", 1, "b"), ("", 58, None), ("d", 0, "d"), ("e", 0, "e"), ("f", 1, "f")]
    want += [(f"g{i}", 58, f"g{i}") for i in range(12)] + [(f"h{i}", 59, f"g{i}") for i in range(12)]
    assert got == sorted(want, key=str)


def test_html_content_is_chosen_by_the_cluster(spark):
    long = "many words of the text " * 60
    flat = " ".join(long.split())
    text = html_extraction.main_text
    assert text(f"<body><main><p>short</p></main><p>{long}</p></body>") == f"short\n{flat}"
    assert text(f"<body><article><p>{long}</p></article><article><p>{long}</p></article><footer>f</footer></body>") == f"{flat}\n{flat}"
    assert text(f'<body><article><div class="article-header"><h1>T</h1><p>by me</p></div><p>{long}</p></article></body>') == f"T\n{flat}"
    assert text(f'<body><div class="header">site</div><div class="post-header"><h1>T</h1></div><p>{long}</p></body>') == f"T\n{flat}"
    assert text(f'<body><section class="legal"><p>{long}</p></section></body>') == flat
    assert text(f'<body><article><p>{long}<span class="ad">buy <span>x</span> ADVERT</span></p></article></body>') == flat
    assert text(f"<body><article><ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>{long}</article></body>") == f"a\nb\nc\nd\n{flat}"
    rows = [(1, None, "u", 1), (2, "", "u", 2), (1, f"<p>{long}", "u", 3), (1, f"<p>{long}", "u", 3), (3, "<p>x" * 20000, None, 4)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text int")
    got = sorted((r.page_id, r.url or "", r.n_chars, r.text[:3]) for r in html_extraction.extract_text(df).collect())
    assert got == [(1, "u", 0, ""), (1, "u", len(flat), flat[:3]), (1, "u", len(flat), flat[:3]), (2, "u", 0, ""), (3, "", 39999, "x\nx")]
    assert html_extraction.extract_text(df.where("false")).count() == 0
