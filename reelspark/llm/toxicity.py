"""Toxicity by a convolutional text classifier trained in numpy.

A word is the mean of hashed embeddings: of the word and of its beginnings, so that
unseen compounds share what their beginnings have learnt. Filters of one, two and three
words slide over the whole text; the largest response of each filter, rectified, goes
into a logistic output. Thresholds are calibrated by language: the language is told from
function words in the text (never from a column), and for each the logits are shifted so
that the score 0.3 falls on the threshold with the best F1 on calibration rows.

Training takes a bounded sample of labelled rows to the driver (TrainingSize); scoring
runs in Arrow batches on the executors with weights of a fixed size.
"""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.word_ids import Codes, chunks, groups
from reelspark.llm.worker import held, trim

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 12, (1, 2, 3)
#: Lengths of the beginnings that have embeddings of their own, beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 7)
THRESHOLD = 0.3
#: Distinct words a worker remembers the filter responses of (288 bytes each).
MAX_WORDS = 120_000
#: Texts are scored together up to so many characters.
GROUP_CHARS = 1 << 18
SLOTS = sum(WIDTHS)

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are with as this be by at from or".split(),
    "de": "der die das und ist ein eine zu den von mit nicht auf für im sich dem auch als wie".split(),
    "fr": "le la les des et est un une du que dans pour qui par sur pas plus au avec ce".split(),
    "es": "el los las y del que en una por con para es se no al lo como más su pero".split(),
}
LANGUAGES = [*FUNCTION_WORDS, ""]
_LANGUAGE = {w: i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words}


@dataclass(frozen=True)
class TrainingSize:
    """At most so many labelled rows of each class, and only texts up to so many characters, are used for fitting."""

    toxic: int = 2000
    clean: int = 4000
    max_chars: int = 50_000
    epochs: int = 8


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding buckets of each word (row), and its language (-1: tells none)."""
    rows = np.empty((len(words), len(BEGINNINGS) + 1), np.int32)
    languages = np.empty(len(words), np.int8)
    for i, chunk in enumerate(words):
        word = chunk.lower().strip(string.punctuation) or chunk
        languages[i] = _LANGUAGE.get(word, -1)
        whole = zlib.crc32(word.encode())
        rows[i, 0] = whole % BUCKETS
        for j, n in enumerate(BEGINNINGS, 1):
            # A shorter word has no such beginning; the whole word stands in.
            rows[i, j] = zlib.crc32(b"^" + word[:n].encode()) % BUCKETS if len(word) >= n else rows[i, 0]
    return rows, languages


@dataclass
class Model:
    embedding: np.ndarray
    filters: np.ndarray
    """(DIM, SLOTS * FILTERS): the parts of each filter, one word wide, width after width."""
    bias: np.ndarray
    output: np.ndarray
    intercept: float = 0.0
    shift: np.ndarray | None = None
    """What is added to the logit, by language."""

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        random = np.random.default_rng(seed)
        draw = lambda *shape, scale: random.normal(0, scale, shape).astype(np.float32)
        return cls(
            draw(BUCKETS, DIM, scale=0.2), draw(DIM, SLOTS * FILTERS, scale=0.3),
            np.zeros(len(WIDTHS) * FILTERS, np.float32), draw(len(WIDTHS) * FILTERS, scale=0.3),
        )

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place."""
        return self.embedding[rows].mean(axis=1) @ self.filters

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.output + self.intercept


def responses(parts: np.ndarray) -> list[np.ndarray]:
    """Responses of the filters of each width at each place; beyond the last place are zeros."""
    out, slot = [], 0
    for width in WIDTHS:
        total = parts[:, slot * FILTERS : (slot + 1) * FILTERS].copy()
        for j in range(1, width):
            total[:-j] += parts[j:, (slot + j) * FILTERS : (slot + j + 1) * FILTERS]
        out.append(total)
        slot += width
    return out


def padded(codes: np.ndarray, lengths: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """`codes` of texts one after the other with enough padding behind each, and where each begins."""
    extra = max(WIDTHS)
    ends = np.cumsum(lengths)
    return np.insert(codes, np.repeat(ends, extra), pad), ends - lengths + extra * np.arange(len(lengths))


def fit(texts: list[str], labels: np.ndarray, calibration: np.ndarray, size: TrainingSize, seed: int = 7) -> Model:
    """A model from the rows that are not for calibration, calibrated on those that are."""
    model, random = Model.fresh(seed), np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        # Nothing to learn: every text gets the share of label 1, by Laplace's rule.
        share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.01
        model.output[:] = 0
        model.intercept = float(np.log(share / (1 - share)))
        model.shift = np.zeros(len(LANGUAGES))
        return model
    words, which, last = chunks(texts)
    rows, languages = features(words)
    rows = np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
    pad, bounds = len(words), np.concatenate([[0], last])
    docs = [which[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    train = np.flatnonzero(~calibration)
    if len(np.unique(labels[train])) < 2:
        train = np.arange(len(texts))
    weight = np.where(labels == 1, (labels[train] == 0).sum() / max(1, (labels[train] == 1).sum()), 1.0) ** 0.5
    squares = [np.full_like(x, 1e-6) for x in (model.embedding, model.filters, model.bias, model.output)]
    b_square = 1e-6

    def forward(chosen: np.ndarray):
        lengths = np.array([len(docs[i]) for i in chosen])
        codes, begins = padded(np.concatenate([docs[i] for i in chosen]) if len(chosen) else which[:0], lengths, pad)
        distinct, codes = np.unique(codes, return_inverse=True)
        vectors = model.embedding[rows[distinct]].mean(axis=1)
        vectors[distinct == pad] = 0
        place, value = [], []
        for r in responses((vectors @ model.filters)[codes]):
            at = [a + r[a : a + max(1, n)].argmax(axis=0) for a, n in zip(begins.tolist(), lengths.tolist())]
            place.append(np.array(at))
            value.append(np.take_along_axis(r, place[-1], axis=0))
        pooled = np.maximum(np.hstack(value) + model.bias, 0)
        return distinct, codes, vectors, place, pooled

    for epoch in range(size.epochs):
        rate = 0.1 * (1 - epoch / size.epochs)
        random.shuffle(train)
        for at in range(0, len(train), 64):
            chosen = train[at : at + 64]
            distinct, codes, vectors, place, pooled = forward(chosen)
            p = 1 / (1 + np.exp(-model.logits(pooled)))
            error = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            back = np.outer(error, model.output) * (pooled > 0)
            gradients = [None, np.zeros_like(model.filters), back.sum(axis=0), pooled.T @ error + 1e-4 * model.output]
            by_word = np.zeros((len(distinct), DIM), np.float32)
            slot = 0
            for k, width in enumerate(WIDTHS):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(width):
                    word = codes[np.minimum(place[k] + j, len(codes) - 1)]
                    own = slice((slot + j) * FILTERS, (slot + j + 1) * FILTERS)
                    gradients[1][:, own] = np.einsum("nf,nfd->df", g, vectors[word])
                    np.add.at(by_word, word, g[:, :, None] * model.filters[:, own].T[None])
                slot += width
            used = np.flatnonzero(by_word.any(axis=1) & (distinct != pad))
            buckets = rows[distinct[used]]
            touched, inverse = np.unique(buckets, return_inverse=True)
            summed = np.zeros((len(touched), DIM), np.float32)
            np.add.at(summed, inverse.reshape(buckets.shape), np.repeat(by_word[used][:, None] / buckets.shape[1], buckets.shape[1], axis=1))
            squares[0][touched] += summed**2
            model.embedding[touched] -= rate * summed / np.sqrt(squares[0][touched])
            for x, square, g in zip((model.filters, model.bias, model.output), squares[1:], gradients[1:]):
                square += g**2
                x -= rate * g / np.sqrt(square)
            b_square += error.sum() ** 2
            model.intercept -= float(rate * error.sum() / np.sqrt(b_square))

    def score(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [model.logits(forward(chosen[i : i + 256])[4]) for i in range(0, len(chosen), 256)]
        return np.concatenate(found), np.array([language(languages[docs[i]]) for i in chosen])

    held = np.flatnonzero(calibration) if calibration.any() else train
    logits, spoken = score(held)
    model.shift = calibrated(logits, spoken, labels[held])
    return model


def language(codes: np.ndarray) -> int:
    """The language with the most function words; the last one where there are none."""
    counts = np.bincount(codes[codes >= 0], minlength=len(LANGUAGES) - 1)
    return int(counts.argmax()) if counts.any() else len(LANGUAGES) - 1


def calibrated(logits: np.ndarray, spoken: np.ndarray, labels: np.ndarray, least: int = 20) -> np.ndarray:
    """Shifts that put the best F1 threshold of each language on the score THRESHOLD.

    The threshold lies midway between two logits. Languages with fewer than `least` rows of
    either label take the threshold of all rows.
    """
    target = np.log(THRESHOLD / (1 - THRESHOLD))

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-z, kind="stable")
        z, hits = z[order], np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
        f1[:-1][z[:-1] == z[1:]] = -1  # equal scores stay together
        k = int(f1.argmax())
        return float(z[k] + z[k + 1]) / 2 if k + 1 < len(z) else float(z[k]) - 1.0

    overall = best(logits, labels) if labels.any() else 0.0
    shift = np.full(len(LANGUAGES), target - overall)
    for i in range(len(LANGUAGES)):
        mine = spoken == i
        if min((labels[mine] == 1).sum(), (labels[mine] == 0).sum()) >= least:
            shift[i] = target - best(logits[mine], labels[mine])
    return shift


class Scorer:
    """A model with the words this worker has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.codes = Codes(self._learn, MAX_WORDS)
        # Room for all that may come before the next reset, so that nothing is copied; untouched pages take no memory.
        room = 2 * MAX_WORDS + GROUP_CHARS
        self.parts = np.zeros((room, SLOTS * FILTERS), np.float32)
        self.languages = np.full(room, -1, np.int8)
        self.known = 1  # number 0 is the padding: no part in anything, no language
        self.codes.next = 1

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            rows, languages = features(words[at : at + 20_000])
            n = len(rows)
            while self.known + n > len(self.parts):
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
                self.languages = np.concatenate([self.languages, np.full_like(self.languages, -1)])
            self.parts[self.known : self.known + n] = self.model.parts(rows)
            self.languages[self.known : self.known + n] = languages
            self.known += n

    def scores(self, texts: Iterator[str | None]) -> np.ndarray:
        out: list[float] = []
        best = counts = None
        carried, tail = np.empty(0, np.int64), []
        for group, more in groups(texts, GROUP_CHARS):
            if self.codes.full:
                self._reset()
                carried = np.array([self.codes.of([w])[0] for w in tail], np.int64)
            words, which, last = chunks(group)
            codes = np.concatenate([carried, self.codes.of(words)[which]])
            lengths = np.diff(last, prepend=0)
            lengths[0] += len(carried)
            # Windows over the cut: the last words of a piece are read again with what follows.
            again = max(WIDTHS) - 1 if more else 0
            carried = codes[len(codes) - min(again, len(codes)) :] if more else codes[:0]
            tail = [*tail, *(words[i] for i in which[-again:].tolist())][-again:] if more else []
            if more and len(codes) <= again:
                continue
            pooled, spoken = self._pool(codes, lengths - again)
            if best is not None:
                pooled[0], spoken[0] = np.maximum(pooled[0], best), spoken[0] + counts
                best = None
            if more:
                best, counts = pooled[0], spoken[0]
                continue
            z = self.model.logits(np.maximum(pooled + self.model.bias, 0))
            tongue = np.where(spoken.any(axis=1), spoken.argmax(axis=1), len(LANGUAGES) - 1)
            # Rounded: the last digits depend on which texts are scored together.
            out += np.round(1 / (1 + np.exp(-np.clip(z + self.model.shift[tongue], -50, 50))), 5).tolist()
        return np.array(out)

    def _pool(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses at the first `lengths` words of each text, and their words by language. A single text may have more words."""
        n, ends = len(LANGUAGES) - 1, np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        tongues = self.languages[codes[: ends[-1]]]
        told = tongues >= 0
        spoken = np.bincount(owner[told] * n + tongues[told], minlength=len(lengths) * n).reshape(-1, n)
        rest = np.zeros(len(lengths), np.int64)
        rest[-1] = len(codes) - ends[-1]
        laid, begins = padded(codes, lengths + rest, 0)
        edges = np.stack([begins, begins + np.maximum(lengths, 1)], 1).ravel()
        found = [np.maximum.reduceat(r, edges)[::2] for r in responses(self.parts[laid])]
        return np.hstack(found), spoken.astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, held_out, size: TrainingSize) -> pd.DataFrame:
    """At most `size` labelled rows outside the held-out part: text, toxic, calibration. The choice follows a hash of doc_id."""
    name = f"label_{uuid.uuid4().hex[:8]}"
    known = labels.select(F.col("doc_id").cast("long").alias(name), F.col("toxic").alias(f"{name}_toxic")).where(
        F.col(name).isNotNull() & F.col(f"{name}_toxic").isin(0, 1) & ~held_out(F.col(name))
    )
    picked = [
        known.where(F.col(f"{name}_toxic") == value).orderBy(F.xxhash64(name), name).limit(n)
        for value, n in ((1, size.toxic), (0, size.clean))
    ]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most toxic + clean rows of two numbers
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= size.max_chars)
    found = short.join(chosen, F.col("doc_id") == F.col(name)).select("text", F.col(f"{name}_toxic").alias("toxic"), F.col("doc_id"))
    rows = found.orderBy("doc_id", "text").limit(2 * (size.toxic + size.clean)).toPandas()
    rows["calibration"] = [zlib.crc32(str(d).encode()) // 4 % 4 == 0 for d in rows["doc_id"]]
    return rows


def default_held_out(doc_id):
    """The rows no label is learnt from: crc32 of doc_id as text, mod 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, held_out=default_held_out, size: TrainingSize = TrainingSize()) -> Model:
    rows = sample(docs, labels, held_out, size)
    model = fit(rows["text"].tolist(), rows["toxic"].to_numpy().astype(int), rows["calibration"].to_numpy().astype(bool), size)
    del rows
    trim()
    return model


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`docs` with two more columns: score (0 to 1) and predicted (1 where score >= 0.3).

    Null and empty texts get the score of no words. Whole texts are read, long ones in pieces.
    Rows stay as they are, repeated ones too. Needs a column `text`; columns of these `names` give way to the new ones.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = held(("toxicity", key), lambda: Scorer(shared.value))
        for texts in batches:
            yield pd.Series(scorer.scores(texts), dtype=float)

    scored = docs.withColumn(names[0], apply(F.col("text")))
    return scored.withColumn(names[1], (F.col(names[0]) >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns as they are; the model learns from `docs` and `labels`."""
    score_name, flag = (f"toxicity_{uuid.uuid4().hex[:8]}_{x}" for x in "sp")
    return score(docs, train(docs, labels), (score_name, flag)).where(F.col(flag) == 0).drop(score_name, flag)
