"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks, trained on sentences.

Two spans of words are alike as far as they share subsequences of three characters (a word's start and end count as characters),
each weighted by DECAY to the number of characters it skips, over stretches of fewer than SPAN + 1; so an insult with inserted, skipped or
changed characters stays near the plain one, and subsequences that cross from word to word tell phrases. Runs of
single-character words are read as one word, marks inside a word as gaps. The kernel is mapped to a few coordinates
through landmark spans (Nystroem), where a linear machine is trained.

A sentence ends at a full stop, a question or exclamation mark or a line feed. It is as toxic as its worst span of one to WORDS words, a
document as its worst sentence. The labels are of documents, so sentences get theirs in training (multiple instances): all
of clean documents are clean; of a toxic document the one that the machine now ranks highest is toxic, by the span that makes it so,
and so is each other one with a word ranked above 0.5. A document in which nothing ranks above 0 teaches nothing that round, unless
that holds for all. The first choice, which stays, has no machine: the span whose share in toxic documents exceeds that in clean ones by the
most standard errors, where anything reaches SURE of them. A span is suspect if that share is over TIMES the other: only suspect ones
are chosen, and only spans of clean documents that neither are nor hold a suspect one are clean examples. So what a few clean documents quote
can be toxic, and words that stand in both kinds can be toxic as a phrase. Clean examples are
NEGATIVES words and a quarter as many longer spans of each length in the order of a hash, and every round the HARD words and half as
many longer spans of each length that the machine ranks worst. A toxic span counts as often as documents have it, 20 times at most, and POSITIVES in all.
A logistic curve over documents gives the score.

As the machine is linear in the landmarks and the kernel in subsequences, it folds into one weight per subsequence
(4 MB, fixed size), so scoring a text is a table look-up: one scan, no shuffle.
It is fitted on the driver on at most SAMPLE labelled training documents, in the order of a hash of the id.
No label, language, source or id enters a score.

Edges: null, empty and blank texts score 0; without labelled documents of both kinds every text scores 0; repeated rows score alike, also in
training, where of rows with equal ids the least text counts; ties go to fewer words, then to what comes first; of very long
texts some sentences are worked on at a time, besides the places of their words; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, table
from .tokens import LOWER, PIECE_BYTES, Words, mix, pieces

SAMPLE, LANDMARKS, DECAY, SPAN, WORDS = 4000, 160, 0.6, 7, 3
POSITIVES, NEGATIVES, HARD, ROUNDS, SURE, TIMES = 6000, 8000, 600, 4, 4.0, 8
LETTERS = 103  # a-z, 0-9, a mark, 64 last bytes of other characters, start, end
MARK, START, END = 36, 101, 102
CLASS = np.full(256, MARK, np.int32)
CLASS[0x61:0x7B] = np.arange(26)
CLASS[0x30:0x3A] = np.arange(26, 36)
CLASS[0x80:0xC0] = np.arange(37, 101)
EDGE_MARKS = b".,;:!?\"'()"
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


def norms(size: np.ndarray) -> np.ndarray:
    """Kernel norm of spans by their number of characters, as if no subsequence occurred twice."""
    total = sum((s - 1) * DECAY ** (2 * (s - 2)) * np.maximum(size - s, 0) for s in range(2, SPAN))
    return np.sqrt(np.maximum(total, 1))


class Spelled:
    """Character classes of words, each between START and END, joined to one array. Words of one unit (a span or a
    sentence) follow each other, and subsequences stay within a unit."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: np.ndarray):
        length = ends - starts
        first = np.cumsum(length) - length
        at = np.arange(length.sum()) + np.repeat(starts - first, length)
        byte = LOWER[data[at]]
        keep = (byte < 0xC0) & (byte > 0x20)
        word = np.repeat(np.arange(len(starts)), length)[keep]
        size = np.bincount(word, minlength=len(starts))
        base = np.cumsum(size + 2) - (size + 2)
        self.chars = np.full(int((size + 2).sum()), START, np.int32)
        self.chars[np.arange(len(word)) + 2 * word + 1] = CLASS[byte[keep]]
        self.chars[base + size + 1] = END
        self.word = np.repeat(np.arange(len(starts), dtype=np.int32), size + 2)
        self.of_word = unit
        self.unit = unit[self.word]
        marks = np.bincount(word, CLASS[byte[keep]] == MARK, len(starts)).astype(int)
        self.room = size - marks + 2

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Places of first characters, subsequences and weight, for each pair of gaps."""
        c = self.chars
        for s in range(2, SPAN):
            n = len(c) - s
            if n > 0:
                at = np.flatnonzero(self.unit[:n] == self.unit[s:])
                for a in range(1, s):
                    yield at, (c[at] * LETTERS + c[at + a]) * LETTERS + c[at + s], DECAY ** (s - 2)

    def _reach(self, weights: np.ndarray) -> np.ndarray:
        """[words, WORDS]: summed weights of subsequences that start in a word and end in it, in the next, and so on."""
        c, words = self.chars, len(self.room)
        total = np.zeros(words * WORDS)
        for s in range(2, SPAN):
            n = len(c) - s
            if n <= 0:
                break
            value = np.zeros(n, np.float32)
            for a in range(1, s):
                value += weights[(c[:n] * LETTERS + c[a : a + n]) * LETTERS + c[s:]]
            step = self.word[s:] - self.word[:n]
            value *= (self.unit[s:] == self.unit[:n]) & (step < WORDS)
            total += np.bincount(self.word[:n] * WORDS + np.minimum(step, WORDS - 1), value, len(total)) * DECAY ** (s - 2)
        return total.reshape(words, WORDS)

    def spans(self, weights: np.ndarray) -> np.ndarray:
        """[words, WORDS]: values of the spans of one word, of two, and so on, that start at each word; -inf where the unit ends before."""
        reach, words = self._reach(weights), len(self.room)
        out = np.full((words, WORDS), -np.inf)
        total, room = np.zeros(words), np.zeros(words)
        for k in range(min(WORDS, words)):
            live = words - k
            for j in range(k + 1):
                total[:live] += reach[j : j + live, k - j]
            room[:live] += self.room[k:]
            inside = self.of_word[k:] == self.of_word[:live]
            out[:live, k] = np.where(inside, total[:live] / norms(room[:live]), -np.inf)
        return out


def spell(spans: list[bytes]) -> Spelled:
    """Each span, its words separated by spaces, as a unit."""
    words = [w for s in spans for w in s.split(b" ")]
    unit = np.repeat(np.arange(len(spans), dtype=np.int32), [s.count(b" ") + 1 for s in spans])
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(size + 1) - (size + 1)
    return Spelled(data, starts, starts + size, unit)


class Sentences:
    """The words of a string column: places, the sentence of each (numbered over the column), and words before each row."""

    def __init__(self, column: pa.Array):
        words = Words(column, lower=True, hashed=False)
        row = words.row_of()
        one = words.ends - words.starts == 1
        glue = np.zeros(len(words), bool)
        if len(words) > 1:  # neighbouring single-character words are one; what separates them is one byte each
            glue[1:] = one[1:] & one[:-1] & (row[1:] == row[:-1]) & (words.starts[1:] == words.ends[:-1] + 1)
        head = np.flatnonzero(~glue)
        tail = np.append(head[1:], len(words))[: len(head)]
        self.data, self.starts, self.row = words.data, words.starts[head], row[head].astype(np.int32)
        self.ends = words.ends[tail - 1] if len(head) else words.ends[:0]
        self.at = np.searchsorted(head, words.at)
        new = np.zeros(len(head), bool)
        if len(head) > 1:
            lines = np.flatnonzero(self.data == 0x0A)
            broken = np.searchsorted(lines, self.starts[1:]) > np.searchsorted(lines, self.ends[:-1])
            new[1:] = (self.row[1:] != self.row[:-1]) | broken | STOP[self.data[self.ends[:-1] - 1]]
        self.sentence = np.cumsum(new, dtype=np.int32)

    def values(self, weights: np.ndarray) -> np.ndarray:
        """`Spelled.spans` of all words, some whole sentences at a time."""
        parts, low, n = [np.zeros((0, WORDS), np.float32)], 0, len(self.starts)
        while low < n:
            high = int(np.searchsorted(self.starts, self.starts[low] + PIECE_BYTES))
            high = int(np.searchsorted(self.sentence, self.sentence[min(high, n) - 1], "right"))
            parts.append(Spelled(self.data, self.starts[low:high], self.ends[low:high], self.sentence[low:high]).spans(weights).astype(np.float32))
            low = high
        return np.concatenate(parts)


def _excess(toxic: np.ndarray, clean: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """By how many standard errors the share of toxic documents exceeds that of clean ones."""
    p = (toxic + clean) / (n[0] + n[1])
    return (toxic / n[1] - clean / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks of the distinct values."""
    order = np.argsort(x, kind="stable").astype(np.int32)
    x = x[order]
    rank = np.zeros(len(x), np.int32)
    rank[order[1:]] = np.cumsum(x[1:] != x[:-1], dtype=np.int32)
    return rank


class Bags:
    """Spans of labelled documents. For each number of words k + 1: `place` (first words), `code` (equal for equal spans),
    and by code the excess of toxic documents and whether it is suspect."""

    def __init__(self, texts: pa.Array, toxic: np.ndarray):
        self.text, self.toxic = Sentences(texts), toxic
        t = self.text
        known: dict[bytes, int] = {}
        blank = b" \t\n\x0b\x0c\r"
        cut = (t.data[a:b].tobytes().translate(None, blank).strip(EDGE_MARKS) for a, b in zip(t.starts, t.ends, strict=True))
        self.id = np.fromiter((known.setdefault(w, len(known)) for w in cut), np.int32, len(t.starts))
        self.words = list(known)
        n = (int((toxic == 0).sum()), int((toxic == 1).sum()))
        self.place, self.code, self.suspect, self.excess = [], [], [], []
        whole = self.id
        for k in range(WORDS):
            live = max(len(self.id) - k, 0)
            if k:
                whole = _dense(whole[:live].astype(np.int64) * len(self.words) + self.id[k:])
            place = np.flatnonzero(t.sentence[k:] == t.sentence[:live]).astype(np.int32)
            code = whole[place]
            top = int(whole.max()) + 1 if len(whole) else 0
            pair = code.astype(np.int64) * len(toxic) + t.row[place]
            pair.sort()
            pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
            label = toxic[pair % len(toxic)]
            pair //= len(toxic)
            count = [np.bincount(pair[label == v], minlength=top).astype(np.int32) for v in (0, 1)]
            self.place.append(place)
            self.code.append(code)
            self.excess.append(_excess(count[1], count[0], n).astype(np.float32))
            self.suspect.append(count[1] * float(n[0]) > TIMES * count[0] * float(n[1]))
        self.plain = []  # whether a span can be a clean example, by place
        for k in range(WORDS):
            words = [self.suspect[0][self.id[self.place[k] + j]] for j in range(k + 1)]
            self.plain.append(~np.logical_or.reduce([*words, self.suspect[k][self.code[k]]]) & (toxic[t.row[self.place[k]]] == 0))

    def span(self, k: int, place: int) -> bytes:
        return b" ".join(self.words[i] for i in self.id[place : place + k + 1])

    def toxic_spans(self, values: np.ndarray | None) -> Counter:
        """The spans that make sentences toxic, and the number of documents; values by first word and number of words, None in the first round."""
        rows, value, length, place, code = [], [], [], [], []
        for k in range(WORDS):
            held = np.flatnonzero(self.toxic[self.text.row[self.place[k]]] == 1)
            held = held[self.suspect[k][self.code[k][held]]]
            p, c = self.place[k][held], self.code[k][held]
            rows.append(self.text.row[p])
            value.append(self.excess[k][c] if values is None else values[p, k])
            length.append(np.full(len(p), k))
            place.append(p)
            code.append(c)
        row, of, k, at, mark = (np.concatenate(x) for x in (rows, value, length, place, code))
        order = np.lexsort((at, k, -of, row))
        best = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
        least = SURE if values is None else 0.0
        best = best[of[best] >= least] if (of[best] >= least).any() else best
        more = best if values is None else np.union1d(best, np.flatnonzero((of > 0.5) & (k == 0)))
        distinct = {(int(row[i]), int(k[i]), int(mark[i])): int(at[i]) for i in more[::-1]}
        return Counter(s for s in (self.span(n, p) for (_, n, _), p in distinct.items()) if s.strip())

    def clean_spans(self, values: np.ndarray | None) -> list[bytes]:
        """Clean examples: spread by a hash, or those with the highest values."""
        out: list[bytes] = []
        for k in range(WORDS):
            held = np.flatnonzero(self.plain[k])
            if values is None:
                most = NEGATIVES if not k else NEGATIVES // 4
                rank = mix(self.code[k][held].astype(np.uint64), k)
            else:
                most = HARD if not k else HARD // 2
                rank = -values[self.place[k][held], k]
            code, first = np.unique(self.code[k][held], return_index=True)
            at = held[first[np.lexsort((code, rank[first]))[:most]]]
            out += [self.span(k, p) for p in self.place[k][at].tolist()]
        return [s for s in dict.fromkeys(out) if s.strip()]


class Machine:
    def __init__(self) -> None:
        self.weights = np.zeros(LETTERS**3, np.float32)
        self.bias, self.slope, self.offset = 0.0, 0.0, -30.0

    def fit_spans(self, landmarks: list[bytes], positive: list[bytes], negative: list[bytes]) -> None:
        marks = spell(landmarks)
        parts = [(t, marks.unit[at], np.full(len(at), d)) for at, t, d in marks.triples()]
        triple, owner, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
        used = np.unique(triple)
        used = used[(used // LETTERS**2 != MARK) & (used // LETTERS % LETTERS != MARK) & (used % LETTERS != MARK)]
        table_ = np.zeros((len(used), len(landmarks)))
        keep = np.isin(triple, used)
        np.add.at(table_, (np.searchsorted(used, triple[keep]), owner[keep]), value[keep])
        table_ /= norms(np.bincount(marks.of_word, marks.room))

        def kernel(spans: list[bytes]) -> np.ndarray:
            out = []
            for low in range(0, len(spans), 400):
                some = spell(spans[low : low + 400])
                room = np.bincount(some.of_word, some.room)
                phi = np.zeros((len(room), len(used)), np.float32)
                for at, t, d in some.triples():
                    place = np.minimum(np.searchsorted(used, t), len(used) - 1)
                    hit = used[place] == t
                    np.add.at(phi, (some.unit[at[hit]], place[hit]), d)
                out.append((phi @ table_.astype(np.float32)) / norms(room)[:, None])
            return np.vstack(out)

        value_, vectors = np.linalg.eigh(kernel(landmarks))
        keep = value_ > 1e-3
        whiten = vectors[:, keep] / np.sqrt(value_[keep])
        x = np.vstack([kernel(positive), kernel(negative)]) @ whiten
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.where(y > 0, 0.5 / len(positive), 0.5 / len(negative))
        w, b = np.zeros(x.shape[1]), 0.0
        cost = 2000.0
        for _ in range(30):  # Newton's method on the squared hinge
            short = np.flatnonzero(y * (x @ w + b) < 1)
            xs, ys, cs = np.hstack([x[short], np.ones((len(short), 1))]), y[short], cost * weight[short]
            ridge = np.diag(np.append(np.ones(x.shape[1]), 1e-6))
            new = np.linalg.solve(ridge + xs.T @ (xs * cs[:, None]), xs.T @ (cs * ys))
            moved = abs(np.append(w, b) - new).max()
            w, b = new[:-1], float(new[-1])
            if moved < 1e-6:
                break
        self.weights = np.zeros(LETTERS**3, np.float32)
        self.weights[used] = table_ @ (whiten @ w)
        self.bias = b

    def worst(self, text: Sentences, values: np.ndarray | None = None) -> np.ndarray:
        """The value of each row's worst sentence; -inf without words."""
        values = text.values(self.weights) + self.bias if values is None else values
        out = np.full(len(text.at) - 1, -np.inf)
        some = np.diff(text.at) > 0
        if some.any():
            out[some] = np.maximum.reduceat(values.max(axis=1), text.at[:-1][some])
        return out

    def fit(self, texts: pa.Array, toxic: np.ndarray) -> Machine:
        bags = Bags(texts, toxic)
        values: np.ndarray | None = None
        spread, hard = bags.clean_spans(None), []
        first = bags.toxic_spans(None)
        for _ in range(ROUNDS):
            chosen = first if values is None else bags.toxic_spans(values) | first
            positive = [s for s, _ in sorted(chosen.items(), key=lambda x: (-x[1], x[0]))]
            if not positive or not spread:
                return self
            landmarks = positive[: LANDMARKS * 2 // 3]
            landmarks = landmarks + [s for s in (hard + spread)[: LANDMARKS - len(landmarks)] if s not in landmarks]
            weighted = [s for s in positive for _ in range(min(chosen[s], 20))]
            self.fit_spans(list(dict.fromkeys(landmarks)), weighted[:POSITIVES], list(dict.fromkeys(hard + spread)))
            values = bags.text.values(self.weights) + np.float32(self.bias)
            hard = list(dict.fromkeys(hard + bags.clean_spans(values)))
        worst = np.maximum(self.worst(bags.text, values), -3.0)
        a, b = 1.0, 0.0
        y = toxic.astype(float)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * worst + b, -30, 30)))
            g = np.array([((y - p) * worst).sum() - 0.05 * a, (y - p).sum()])
            v = p * (1 - p)
            h = np.array([[(v * worst * worst).sum() + 0.05, (v * worst).sum()], [(v * worst).sum(), v.sum() + 1e-3]])
            step_ = np.clip(np.linalg.solve(h, g), -2, 2)
            a, b = a + float(step_[0]), b + float(step_[1])
        self.slope, self.offset = a, b
        return self

    def score(self, worst: np.ndarray) -> np.ndarray:
        return np.where(np.isneginf(worst), 0.0, 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(worst, -30) + self.offset, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    chosen = labelled_sample(docs, labels, learn, key=key, text=text, label=label, sample=sample)
    got = chosen.toArrow()
    got = got.take(pc.sort_indices(got, [("label", "ascending"), ("text", "ascending")]))
    toxic = got["label"].to_numpy().astype(int)
    machine = Machine()
    return machine.fit(got["text"].combine_chunks(), toxic) if len(set(toxic.tolist())) == 2 else machine


def _scores(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        yield batch.append_column("score", pa.array(machine.score(machine.worst(Sentences(batch.column("text"))))))


def toxicity_scores(docs: DataFrame, machine: Machine, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    out = source.mapInArrow(lambda b: _scores(b, shared.value), f"key {kind}, text string, score double")
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "score")


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"), F.expr(f"not {HELD_OUT}"))
    return toxicity_scores(docs, machine).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"))
