"""The toxicity machine against a brute-force kernel, and what sentences and phrases teach it."""

import random

import numpy as np
import pyarrow as pa

from graphloom.llm import toxicity
from graphloom.llm.toxicity import CLASS, DECAY, END, LETTERS, MARK, SPAN, START, WORDS, Machine, Sentences, spell

COMMON = "you are nice dirty dog this is a good day for the old house with some green trees and water near our small town".split()


def score(machine, *texts):
    return machine.score(machine.worst(Sentences(pa.array(texts, pa.large_string())))).tolist()


def characters(words):
    return [c for w in words for c in (START, *(int(CLASS[b]) for b in w.lower() if 0x20 < b < 0xC0), END)]


def brute(words, weights):
    """Value of one span: each triple of places less than SPAN apart, over the norm as if all subsequences were distinct."""
    c, total, norm = characters(words), 0.0, 0.0
    room = len(c) - sum(x == MARK for x in c)
    for i in range(len(c)):
        for j in range(i + 1, len(c)):
            for k in range(j + 1, min(len(c), i + SPAN)):
                total += weights[(c[i] * LETTERS + c[j]) * LETTERS + c[k]] * DECAY ** (k - i - 2)
    for i in range(room):
        for j in range(i + 1, room):
            for k in range(j + 1, min(room, i + SPAN)):
                norm += DECAY ** (2 * (k - i - 2))
    return total / max(norm, 1.0) ** 0.5


def test_spans_equal_brute_force():
    rng = random.Random(5)
    weights = np.random.default_rng(5).normal(size=LETTERS**3).astype(np.float32)
    for _ in range(20):
        sentences = [["".join(rng.choices("abCé9-ß", k=rng.randint(2, 8))) for _ in range(rng.randint(1, 6))] for _ in range(4)]
        got = Sentences(pa.array(["\n".join(" ".join(s) for s in sentences)])).values(weights)
        at = 0
        for s in sentences:
            for i in range(len(s)):
                for k in range(WORDS):
                    words = [w.encode() for w in s[i : i + k + 1]]
                    if i + k < len(s):
                        assert abs(got[at, k] - brute(words, weights)) < 1e-3
                    else:
                        assert np.isneginf(got[at, k])
                at += 1


def test_landmarks_fold_into_weights():
    rng = random.Random(6)
    some = lambda n: [b" ".join(bytes(rng.choices(b"abcdef", k=5)) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    machine, positive, negative = Machine(), some(20), some(60)
    machine.fit_spans(positive[:5] + negative[:5], positive, negative)
    for s in positive + negative:
        got = Sentences(pa.array([s.decode()])).values(machine.weights)
        assert abs(got[0, s.count(b" ")] - brute(s.split(b" "), machine.weights)) < 1e-3
    assert len(spell(positive).room) == sum(s.count(b" ") + 1 for s in positive)


def test_sentence_borders():
    text = Sentences(pa.array(["One two. Three four! five\nsix", None, "", "a b c next?  last"]))
    words = [text.data[a:b].tobytes().decode() for a, b in zip(text.starts, text.ends, strict=True)]
    assert words == ["one", "two.", "three", "four!", "five", "six", "a b c", "next?", "last"]
    assert text.sentence.tolist() == [0, 0, 1, 1, 2, 3, 4, 4, 5]
    assert text.at.tolist() == [0, 6, 6, 6, 9]


def fitted(insult, clean_too=()):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choices(COMMON, k=n)).replace("dirty dog", "dirty house")
    clean = [f"{line(12)}. {line(10)}." for _ in range(80)] + [f"{line(6)} {x} {line(3)}." for x in clean_too]
    toxic = [f"{line(8)} {insult} {line(4)}. {line(9)}." for _ in range(40)]
    return Machine().fit(pa.array(clean + toxic), np.array([0] * len(clean) + [1] * 40))


def test_phrases_of_ordinary_words():
    machine = fitted("you dirty dog")
    bad = score(machine, "you dirty dog", "the dirty dogg is near")
    good = score(machine, "you are nice", "a dog near the dirty town", "dirty. Dog is good", None, "", " \n")
    assert min(bad) > 0.5 and max(good[:3]) < 0.5 and good[3:] == [0.0] * 3


def test_insults_that_clean_documents_quote():
    machine = fitted("blorvax", clean_too=["blorvax"])
    assert min(score(machine, "you blorvax", "you blorvvax", "you blo-rvax", "b l o r v a x")) > 0.5
    assert max(score(machine, "you are nice", "good old house")) < 0.5


def test_empty_and_wordless_training():
    for texts, toxic in (([None, ""], [0, 1]), (["...", "good day"], [1, 0]), (["bad", ""], [1, 0])):
        assert score(Machine().fit(pa.array(texts), np.array(toxic)), "good day", None)[1] == 0.0


def test_equal_texts_score_alike_and_long_texts_by_parts(monkeypatch):
    machine = fitted("you dirty dog")
    text = ("this is a good day. " * 400) + "you dirty dog"
    whole = score(machine, text, text)
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 100)
    assert score(machine, text, text) == whole and whole[0] == whole[1] > 0.5
