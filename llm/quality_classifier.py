"""Quality classifier: ordinal regression on graded ratings with hashed text weights."""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import per_row, texts, whole_texts
from llm.quality_rules import labelled

# Rated rows that the model is fitted on, and bytes of their texts, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 16 << 20
BITS = 17
# Buckets of the features that are no word or shape, at the end of the table.
SAME_AS_BEFORE, REPEATED, ALWAYS, EMPTY = range((1 << BITS), (1 << BITS) + 4)

_SHAPES = bytes(65 if 65 <= b < 91 else 48 if 48 <= b < 58 else 97 if 97 <= b < 123 or b > 127 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def buckets_of(word: bytes) -> tuple[int, int]:
    """Of the word in lower case, and of its shape: letters, capitals and digits each as one
    sign, a run as two."""
    mask = (1 << BITS) - 1
    return zlib.crc32(word.lower()) & mask, zlib.crc32(_RUN.sub(rb"\1\1", word.translate(_SHAPES)), 1) & mask


def features(documents: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of all features: shares of the words, and of those that
    repeat. Words are hashed once for all documents given."""
    places: dict[bytes, int] = {}
    rows, words, values, extra = [], [], [], []
    for d, text in enumerate(documents):
        found = text.encode("utf-8", "replace").split()
        n = len(found)
        extra.append((d, ALWAYS, 1.0))
        if not n:
            extra.append((d, EMPTY, 1.0))
            continue
        numbers = np.fromiter((places.setdefault(w, len(places)) for w in found), np.int64, n)
        distinct, count = np.unique(numbers, return_counts=True)
        rows.append(np.full(len(distinct), d))
        words.append(distinct)
        values.append(count / n)
        extra.append((d, SAME_AS_BEFORE, float((numbers[1:] == numbers[:-1]).mean()) if n > 1 else 0.0))
        extra.append((d, REPEATED, 1 - len(distinct) / n))
    hashed = np.array([buckets_of(w) for w in places], np.int64).reshape(-1, 2)
    row, word, value = (np.concatenate([*part, np.zeros(0, np.int64)]) for part in (rows, words, values))
    e = np.array(extra).reshape(-1, 3)
    word = word.astype(np.int64)
    return (np.concatenate([row, row, e[:, 0]]).astype(np.int64), np.concatenate([hashed[word, 0], hashed[word, 1], e[:, 1]]).astype(np.int64),
            np.concatenate([value, value, e[:, 2]]).astype(float))


@dataclass
class Ordinal:
    """Cumulative links: P(grade <= k) is the logistic of threshold k less the score, with one
    score for all grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, documents: list[str]) -> np.ndarray:
        """P(grade > k) for each document and threshold."""
        row, bucket, value = features(documents)
        score = np.bincount(row, value * self.weights[bucket], len(documents))
        return logistic(score[:, None] - self.thresholds)


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(documents: list[str], grades: np.ndarray, levels: int, rounds=300, rate=0.2, decay=1e-5) -> Ordinal:
    """By Adam on the likelihood of the grades. The steps between thresholds are exponentials,
    which keeps them in order."""
    row, bucket, value = features(documents)
    share = np.cumsum(np.bincount(grades, minlength=levels) + 1.0) / (len(grades) + levels)
    start = np.log(share[:-1] / (1 - share[:-1]))
    p = [np.zeros((1 << BITS) + 4), np.array([start[0]]), np.log(np.maximum(np.diff(start), 1e-3))]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in p]
    at = np.arange(len(grades))
    for step in range(1, rounds + 1):
        theta = np.concatenate([[-np.inf], np.cumsum(np.concatenate([p[1], np.exp(p[2])])), [np.inf]])
        score = np.bincount(row, value * p[0][bucket], len(grades))
        upper, lower = logistic(theta[grades + 1] - score), logistic(theta[grades] - score)
        likely = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        by_score = (up - down) / len(grades)  # of the negative logarithm
        by_theta = np.zeros(levels + 1)
        np.add.at(by_theta, grades[at] + 1, -up / len(grades))
        np.add.at(by_theta, grades[at], down / len(grades))
        inner = by_theta[1:levels]
        grads = [np.bincount(bucket, value * by_score[row], len(p[0])) + decay * p[0], np.array([inner.sum()]),
                 np.exp(p[2]) * np.cumsum(inner[::-1])[::-1][1:]]
        for v, g, (m, s) in zip(p, grads, moments):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return Ordinal(p[0], np.cumsum(np.concatenate([p[1], np.exp(p[2])])))


def fit(docs: DataFrame, ratings: DataFrame, rows=SAMPLE_ROWS, size=SAMPLE_BYTES) -> Ordinal | None:
    """From at most ``rows`` of ``ratings`` (doc_id, grade from 0), the first by a hash of the
    id, and the whole texts of these documents, ``size`` bytes in all; texts too long for what
    is left are passed over. None unless two grades occur; an error if no text of one fits."""
    found, labels = whole_texts(labelled(docs, ratings, "grade", rows), size, "quality-sample")
    grades = np.array(labels, np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    return fit_ordinal(found, grades, int(grades.max()) + 1)


def classify(docs: DataFrame, model: Ordinal | None, least=1, cut=0.5, keep=None) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` (of grade ``least`` or better) and
    ``kept`` (this is ``cut`` at least).

    Whole texts, in one pass without a shuffle. Null and empty texts have a feature of their
    own; without a model all is kept, with null figures. Repeated rows are judged alike.
    """
    new = ("expected_grade", "tail_probability", "kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def make():
        def function(batch):
            values, waiting, held = [np.zeros((0, 2))], [], 0

            def flush():
                tails = model.tails(waiting)
                values.append(np.stack([tails.sum(1), tails[:, min(least, tails.shape[1]) - 1] if least else np.ones(len(tails))], 1))

            for text in texts(batch.column(0)):
                waiting.append(text)
                held += len(text)
                if model and held > 4_000_000:  # characters whose words are hashed together
                    flush()
                    waiting, held = [], 0
            if model is None:
                none = pa.nulls(len(batch), pa.float64())
                return [none, none]
            if waiting:
                flush()
            out = np.concatenate(values)
            return [pa.array(out[:, 0]), pa.array(out[:, 1])]

        return function

    out = per_row(docs, ["text"], "expected_grade double, tail_probability double", make, keep)
    return out.withColumn("kept", F.coalesce(F.col("tail_probability") >= cut, F.lit(True)))


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from two labels: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))
