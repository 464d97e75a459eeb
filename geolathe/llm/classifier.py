"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text has the score s = w . x over hashed words (present or not) and a few measures of form; the grade y of 0..K
has P(y > k) = sigmoid(s - t_k) with ordered thresholds t_0 < t_1 < ... that share the weights. The expected grade
is the sum of these, the tail probability is P(y = K), and documents are kept by it.

The model is fitted in one task on a bounded sample of labelled rows (SAMPLE, by a hash of the id); everything is
scored. Defined results: null and empty texts have no words and are scored by their measures; label rows with a
null are left out, and of several for one id the lowest grade counts; a label below 0 counts as 0, one above 1 as 1; with no labels, or one grade only, weights
are 0 and the thresholds give the grades' shares; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import stage
from ._words import bounds, chunks, hash_spans, lower, spans
from .quality import COUNTS, text_counts

BITS = 18
SAMPLE = 12_000
#: Least tail probability of a kept text; chosen on held-out labels, where clean texts lie near 1.
KEEP = 0.9
#: A hashed word counts if so many sampled texts have it, and their mean grade is off by so many standard errors
#: and so much of a grade; words that only tell which texts are copies of one another do not add up then.
LEAST_TEXTS = 4
LEAST_ERRORS = 4.0
LEAST_EFFECT = 0.3
_OTHER = np.ones(256, bool)
_OTHER[97:123] = _OTHER[128:] = False
_FORM = 6


@dataclass
class Model:
    weights: np.ndarray
    form: np.ndarray
    thresholds: np.ndarray


def grade(quality: Column, toxic: Column) -> Column:
    """0 to 2: good and not toxic is 2, one fault 1, both 0; other numbers count as the nearer of 0 and 1."""
    good, bad = (F.greatest(F.lit(0), F.least(F.lit(1), F.round(c.cast("double")).cast("int"))) for c in (quality, toxic))
    return good + 1 - bad


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words, distinct in each text; their bounds; measures of form, one row a text)."""
    n = len(off) - 1
    low = lower(data)
    starts, ends, owner = spans(low, off, _OTHER)
    word = (hash_spans(low, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(owner << BITS | word)
    owner, word = both >> BITS, both & ((1 << BITS) - 1)
    c = dict(zip(COUNTS, text_counts(data, off).T))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    form = np.stack(
        (
            np.minimum(1, 3 * c["n_symbols"] / words),
            np.minimum(1, 2 * c["n_capitals"] / chars),
            np.minimum(1, 2 * c["n_shouts"] / words),
            np.minimum(1, 2 * c["n_repeat_words"] / words),
            np.minimum(1, 2 * c["n_dup_lines"] / np.maximum(c["n_lines"], 1)),
            np.minimum(1, 3 / words),
        ),
        1,
    )
    return word, bounds(owner, n), form


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(words: list[np.ndarray], form: np.ndarray, y: np.ndarray, grades: int, epochs: int = 60, rate: float = 0.4, decay: float = 1e-6) -> Model:
    """Maximum likelihood by Adagrad over shuffled batches."""
    w, f = np.zeros(1 << BITS), np.zeros(_FORM)
    share = np.array([(np.sum(y > k) + 0.5) / (len(y) + 1) for k in range(grades - 1)])
    t = np.sort(-np.log(share / (1 - share)))
    if not len(y) or len(np.unique(y)) < 2:
        return Model(w, f, t)
    df, total = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for x, g in zip(words, y):
        df[x] += 1
        total[x] += g
    effect = np.abs(total / np.maximum(df, 1) - y.mean())
    telling = (df >= LEAST_TEXTS) & (effect * np.sqrt(df) >= LEAST_ERRORS * y.std()) & (effect >= LEAST_EFFECT)
    words = [x[telling[x]] for x in words]
    gw, gf, gt = np.full(len(w), 1e-2), np.full(_FORM, 1e-2), np.full(len(t), 1.0)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            b = order[i : i + 64]
            size = [len(words[j]) for j in b]
            flat = np.concatenate([words[j] for j in b])
            at = np.repeat(np.arange(len(b)), size)
            s = np.bincount(at, w[flat], len(b)) + form[b] @ f
            p = _sigmoid(s[:, None] - t[None, :])
            # log P(y) = log(P(y > y-1) - P(y > y)), P(y > -1) = 1, P(y > K-1) = 0
            full = np.concatenate((np.ones((len(b), 1)), p, np.zeros((len(b), 1))), 1)
            slope = np.concatenate((np.zeros((len(b), 1)), p * (1 - p), np.zeros((len(b), 1))), 1)
            rows = np.arange(len(b))
            mass = np.maximum(full[rows, y[b]] - full[rows, y[b] + 1], 1e-9)
            ds = (slope[rows, y[b]] - slope[rows, y[b] + 1]) / mass
            dt = np.zeros_like(p)
            for k in range(grades - 1):
                dt[:, k] = (np.where(y[b] == k, 1.0, 0.0) - np.where(y[b] == k + 1, 1.0, 0.0)) * slope[:, k + 1] / mass
            g = np.bincount(flat, ds[at], len(w)) / len(b)
            on = np.unique(flat)
            g = g[on] - decay * w[on]
            gw[on] += g * g
            w[on] += rate * g / np.sqrt(gw[on])
            g = form[b].T @ ds / len(b) - decay * f
            gf += g * g
            f += rate * g / np.sqrt(gf)
            g = dt.mean(0)
            gt += g * g
            t = np.maximum.accumulate(t + rate * g / np.sqrt(gt) + np.arange(len(t)) * 1e-9)
    return Model(w, f, t)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about ``sample`` labelled rows; labels: doc_id, quality, toxic."""
    rated = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("y"))
    n = rated.count()
    if n > sample:
        rated = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    rated = stage(rated.withColumnRenamed("doc_id", "_id"), "rated")
    picked = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("_id")).select("text", "y")  # about ``sample`` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in chunks(batch.column(0)):
                word, at, form = features(data, off)
                yield pa.RecordBatch.from_arrays([pa.array([word[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()), pa.array([x.tobytes() for x in form], pa.binary()), batch.column(1).slice(row, len(form))], names=["words", "form", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, form, y = [], [], []
        for batch in batches:
            words += [np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()]
            form += [np.frombuffer(x) for x in batch.column(1).to_pylist()]
            y += batch.column(2).to_pylist()
        # in an order of their own, whatever order the rows came in
        order = sorted(range(len(y)), key=lambda i: (words[i].tobytes(), y[i]))
        m = fit([words[i] for i in order], np.array([form[i] for i in order]).reshape(-1, _FORM), np.array([y[i] for i in order], np.int64), 3)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (m.weights, m.form, m.thresholds)], names=["w", "f", "t"])

    found = stage(picked.mapInArrow(extract, "words binary, form binary, y int"), "features")
    row = found.coalesce(1).mapInArrow(learn, "w binary, f binary, t binary").first()
    if row is None:
        return fit([], np.zeros((0, _FORM)), np.zeros(0, np.int64), 3)
    return Model(*(np.frombuffer(bytes(row[c])) for c in ("w", "f", "t")))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """(doc_id, score, expected_grade, tail_probability, kept) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, off in chunks(batch.column(1)):
                word, at, form = features(data, off)
                total = np.concatenate(([0.0], np.cumsum(model.weights[word])))
                s = total[at[1:]] - total[at[:-1]] + form @ model.form
                p = _sigmoid(s[:, None] - model.thresholds[None, :])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(s)), pa.array(s), pa.array(p.sum(1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= keep)], names=["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = slim.select("doc_id").schema.add("score", "double").add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")
    return slim.mapInArrow(run, fields)
