"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from features of its own and of its neighbours; the transition weights make runs of
like lines likelier. Document labels are all there is to learn from, so lines of good documents are good, and those of bad
documents start as bad and are then relabelled by the field itself (the worst line always stays bad).
The forward-backward marginals, weighted by line length, give a document's share of good text,
which a logistic curve fitted on the training documents turns into the score.

The field is fitted on the driver on at most SAMPLE labelled training documents, the first in the order of a
hash of the id, with all their lines; features are taken on the executors. Scoring
covers every line of every text, in one scan without a shuffle. No label, language, source or id enters a score.

Edges: null and empty texts, and texts of white space only, have no line and score 0; without labelled documents of both
kinds nothing can be learnt and all scores are 0.5 (0 without a line); repeated rows score alike, also in training, where of rows with equal ids the
least text counts; very long texts are worked on one at a time in the memory of their lines; an empty table gives an empty result; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, table
from .tokens import PLAIN, Words, pieces

SAMPLE = 6000
NAMES = ("length", "words", "capitals", "digits", "symbols", "bars", "shouts", "other marks", "stops", "word length", "long words", "same as last word", "seen in line", "same line before", "short", "beyond ASCII")
WIDTH = len(NAMES)


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines that hold a word, their lengths in bytes, and their offsets by row."""
    data, n = words.data, len(words)
    if not n:
        return np.zeros((0, WIDTH)), np.zeros(0), np.zeros(len(words.at), int)
    breaks = np.cumsum(data == 0x0A)
    line = breaks[words.starts]
    row = words.row_of()
    first = np.ones(n, bool)
    first[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    tail = np.append(head[1:], n)
    low, high = words.starts[head], words.ends[tail - 1]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[high] - total[low]).astype(float)

    def over_words(value: np.ndarray) -> np.ndarray:
        return np.add.reduceat(value.astype(float), head)

    size = (high - low).astype(float)
    size_words = (tail - head).astype(float)
    letters = np.maximum(count(PLAIN[data]), 1)
    span = words.ends - words.starts
    same = np.zeros(n, bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & ~first[1:]
    number = np.cumsum(first) - 1
    order = np.lexsort((words.hashes, number))
    again = np.zeros(n, bool)
    again[order[1:]] = (words.hashes[order[1:]] == words.hashes[order[:-1]]) & (number[order[1:]] == number[order[:-1]])
    # A line is the sum of its words' hashes by place; equal ones within a row are repeats.
    place = (np.arange(n) - head[number]).astype(np.uint64)
    mark = np.add.reduceat(words.hashes * (place * np.uint64(2) + np.uint64(1)), head)
    rows = row[head]
    by = np.lexsort((np.arange(len(head)), mark, rows))
    repeat = np.zeros(len(head))
    repeat[by[1:]] = (mark[by[1:]] == mark[by[:-1]]) & (rows[by[1:]] == rows[by[:-1]])
    lookup = np.zeros(256, bool)

    def among(chars: bytes) -> np.ndarray:
        table_ = lookup.copy()
        table_[np.frombuffer(chars, np.uint8)] = True
        return count(table_[data])

    features = np.stack(
        [
            np.log1p(size),
            np.log1p(size_words),
            count((data >= 0x41) & (data <= 0x5A)) / letters,
            count((data >= 0x30) & (data <= 0x39)) / letters,
            among(b"#*$%&^~=<>@_\\{}[]") / letters * 4,
            among(b"|") / size_words,
            among(b"!?") / size_words,
            among(b"-+/:;()\"'`") / size_words,
            among(b".,") / size_words,
            over_words(span) / size_words / 10,
            over_words(span > 15) / size_words,
            over_words(same) / size_words,
            over_words(again) / size_words,
            repeat,
            (size_words < 4).astype(float),
            count(data >= 0xC2) / letters,
        ],
        axis=1,
    )
    return features, size, np.searchsorted(rows, np.arange(len(words.at)))


def beside(features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (0 beyond the ends), whether there is one, and a constant."""
    n = len(features)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    before, after = np.zeros((n, WIDTH)), np.zeros((n, WIDTH))
    has_before, has_after = np.zeros(n), np.zeros(n)
    if n > 1:
        same = row[1:] == row[:-1]
        before[1:] = features[:-1] * same[:, None]
        after[:-1] = features[1:] * same[:, None]
        has_before[1:] = has_after[:-1] = same
    return np.hstack([features, before, after, np.stack([has_before, has_after, np.ones(n)], axis=1)])


def marginals(energy: np.ndarray, at: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2), and the log partition sum. Energy is of good against bad.

    All documents go forward and backward together, a line at a time, the longest first."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    alive = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left") if len(size) else np.zeros(0, int)
    emit = np.stack([np.zeros(len(energy)), energy], axis=1)
    forward, backward = np.zeros((len(energy), 2)), np.zeros((len(energy), 2))
    for t, k in enumerate(alive):
        k = int(k)
        i = begin[:k] + t
        if t:
            was = forward[i - 1]
            forward[i] = np.logaddexp(was[:, :1] + step[0], was[:, 1:] + step[1]) + emit[i]
        else:
            forward[i] = emit[i]
    for t in range(len(alive) - 2, -1, -1):
        i = begin[: int(alive[t + 1])] + t
        ahead = backward[i + 1] + emit[i + 1]
        backward[i] = np.stack([np.logaddexp(step[s, 0] + ahead[:, 0], step[s, 1] + ahead[:, 1]) for s in (0, 1)], axis=1)
    last = begin[size > 0] + size[size > 0] - 1
    whole = np.zeros(len(at) - 1)
    whole[order[size > 0]] = np.logaddexp(forward[last, 0], forward[last, 1])
    total = np.repeat(whole, np.diff(at))
    good = np.exp(forward[:, 1] + backward[:, 1] - total)
    inner = np.ones(len(energy), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    i = np.flatnonzero(inner)
    pair = np.exp(forward[i - 1][:, :, None] + step[None] + (emit[i] + backward[i])[:, None, :] - total[i][:, None, None]).sum(axis=0) if len(i) else np.zeros((2, 2))
    return np.clip(good, 0, 1), pair, float(whole.sum())


class Field:
    def __init__(self) -> None:
        self.weights, self.step = np.zeros(3 * WIDTH + 3), np.zeros((2, 2))
        self.centre, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.slope, self.offset = 0.0, 0.0

    def seen(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        return beside(np.clip((features - self.centre) / self.scale, -8, 8), at)

    def good(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        return marginals(self.seen(features, at) @ self.weights, at, self.step)[0]

    def share(self, features: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each row."""
        if not len(features):
            return np.zeros(len(at) - 1)
        sums = np.concatenate([[0.0], np.cumsum(self.good(features, at) * size)])
        weight = np.concatenate([[0.0], np.cumsum(size)])
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(weight[at[1:]] - weight[at[:-1]], 1e-9)

    def _climb(self, seen: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int) -> None:
        """Penalised likelihood by Adam; weight is of each document's lines."""
        theta = np.concatenate([self.weights, self.step.ravel()])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        inner = np.ones(len(seen), bool)
        inner[at[:-1][np.diff(at) > 0]] = False
        i = np.flatnonzero(inner)
        told = np.zeros((2, 2))
        np.add.at(told, (label[i - 1], label[i]), 1.0)
        for t in range(1, rounds + 1):
            good, pair, _ = marginals(seen @ theta[:-4], at, theta[-4:].reshape(2, 2))
            slope = np.concatenate([seen.T @ (weight * (label - good)), (told - pair).ravel()]) / len(seen) - 1e-4 * theta
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            theta = theta + 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.weights, self.step = theta[:-4], theta[-4:].reshape(2, 2)

    def fit(self, features: np.ndarray, size: np.ndarray, at: np.ndarray, label: np.ndarray) -> Field:
        self.centre, self.scale = features.mean(axis=0), features.std(axis=0) + 1e-3
        seen, row = self.seen(features, at), np.repeat(np.arange(len(label)), np.diff(at))
        weight = np.ones(len(features))
        mark = label[row].copy()
        for _ in range(3):
            self._climb(seen, at, mark, weight, 150)
            good = marginals(seen @ self.weights, at, self.step)[0]
            mark = label[row].copy()
            bad = label[row] == 0
            mark[bad & (good > 0.5)] = 1
            worst = np.full(len(label), 2.0)
            np.minimum.at(worst, row, good)
            mark[bad & (good <= worst[row])] = 0
        share = self.share(features, size, at)
        a = b = 0.0
        x = (share - 0.9) * 10
        for _ in range(50):  # Newton's steps of a slightly penalised logistic curve
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((label - p) * x).sum() - 1e-2 * a, (label - p).sum() - 1e-2 * b])
            w = p * (1 - p)
            h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        self.slope, self.offset = a, b
        return self

    def score(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (share - 0.9) * 10 + self.offset, -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        features, size, at = lines(Words(batch.column("text")))
        take = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([features[t].ravel().tolist() for t in take], pa.list_(pa.float64())), pa.array([size[t].tolist() for t in take], pa.list_(pa.float64()))], names=["label", "features", "size"])


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Field:
    """The field of the labelled documents for which learn holds."""
    chosen = labelled_sample(docs, labels, learn, key=key, text=text, label=label, sample=sample)
    got = chosen.mapInArrow(_features, "label int, features array<double>, size array<double>").toArrow()
    field = Field()
    label_ = np.array(got["label"].to_pylist(), int)
    rows = [np.array(x).reshape(-1, WIDTH) for x in got["features"].to_pylist()]
    sizes = [np.array(x) for x in got["size"].to_pylist()]
    keep = [i for i in range(len(rows)) if len(rows[i])]
    if len(set(label_[keep].tolist())) < 2:
        return field
    keep.sort(key=lambda i: (rows[i].tobytes(), label_[i]))  # one order, however the rows came in
    return field.fit(np.vstack([rows[i] for i in keep]), np.concatenate([sizes[i] for i in keep]), np.concatenate([[0], np.cumsum([len(rows[i]) for i in keep])]), label_[keep])


def _scores(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        features, size, at = lines(Words(batch.column("text")))
        score = np.where(np.diff(at) > 0, field.score(field.share(features, size, at)), 0.0)
        yield batch.append_column("score", pa.array(score))


def quality_scores(docs: DataFrame, field: Field, *, text: str = "text", score: str = "score") -> DataFrame:
    """The rows of docs with a score from 0 to 1, which takes the place of a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = [c for c in docs.columns if c != score]
    # Columns travel under names of their own, so none clashes.
    source = docs.select(*(F.col(f"`{c}`").alias("text" if c == text else f"c{i}") for i, c in enumerate(names)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
    out = source.mapInArrow(lambda b: _scores(b, shared.value), f"{kinds}, score double")
    return out.toDF(*names, score)


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, table(spark, sf_dir, "labels"), F.expr(f"not {HELD_OUT}"))
    return quality_scores(docs, field).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"))
