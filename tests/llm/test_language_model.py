"""Language-model scores against counts by hand."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import language_model as lm

TEXTS = ["the cat sat on the mat", "the dog sat", "The cat  ran\non the mat", "", None, "a b a b a b", "the cat sat on the mat", "new words only here"] * 12


def kind_of(i):
    fold = zlib.crc32(str(i).encode()) % 5
    return lm.SCORED if fold == 1 else lm.HELD if fold == 4 else lm.COUNTED


def scored(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    kind = F.when(fold == 1, lm.SCORED).when(fold == 4, lm.HELD).otherwise(lm.COUNTED)
    return {r["doc_id"]: r for r in lm.score(df, kind).collect()}


def by_hand(rows):
    tokens = {i: (t or "").lower().split() + [""] for i, t in rows}
    grams = {k: (Counter(), Counter()) for k in range(3)}
    for i, ws in tokens.items():
        one, two = grams[kind_of(i)]
        one.update(ws)
        two.update(zip(["", *ws], ws))
    (c1, c2), (h1, h2) = grams[lm.COUNTED], grams[lm.HELD]
    n1 = sum(c1.values())
    cells = Counter()
    for (a, b), n in h2.items():
        step = lambda p: int(np.rint(lm.STEPS * math.log2(p))) if p else 1
        cells[int(lm.context_class(np.array([c1[a]]))[0]), step(c2[a, b] / max(c1[a], 1)), step(c1[b] / n1)] += n
    weights = lm.learn_weights([(*k, n) for k, n in sorted(cells.items())], len(c1))
    one, two = c1 + h1, c2 + h2
    total, words, out = sum(one.values()), len(one), {}
    for i, ws in tokens.items():
        score = base = 0.0
        for a, b in zip(["", *ws], ws):
            w = weights[lm.context_class(np.array([one[a]]))[0]]
            score += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / total + w[2] / (words + 1))
            base += math.log10((one[b] + 0.5) / (total + 0.5 * (words + 1)))
        out[i] = (len(ws), sum(one[b] > 0 for b in ws), total, base, score)
    return out


@pytest.mark.parametrize("size", [lm.CHUNK_BYTES, 60])
def test_scores_do_not_depend_on_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(lm, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm, "GROUP_GRAMS", size)
    rows = list(enumerate(TEXTS))
    got, want = scored(spark, rows), by_hand(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert tuple(got[i])[1:4] == w[:3]
        assert tuple(got[i])[4:] == pytest.approx(w[3:])


def test_nothing_to_learn_from(spark):
    only = next(i for i in range(50) if kind_of(i) == lm.SCORED)
    row = scored(spark, [(only, "a b")])[only]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and math.isfinite(row["score"])
    assert scored(spark, []) == {}


def test_repeated_rows_and_null_ids_are_scored_each(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, None, 1), (3, "a", 1), (3, "a", 1)], "doc_id long, text string, score int")
    out = lm.score(df, F.lit(lm.COUNTED))
    assert sorted(r["n_tokens"] for r in out.collect()) == [1, 2, 2, 3] and out.columns[0] == "doc_id"


def test_weights_learned_favour_what_predicts():
    weights = lm.learn_weights([(3, -8, -80, 90), (3, 1, -80, 10), (5, 1, -8, 100)], 1000)
    assert weights.sum(1) == pytest.approx(np.ones(lm.CLASSES + 1))
    assert weights[3][0] > 0.6 and weights[5][1] > 0.9 and (weights[4] == weights[3]).all() and weights[0][0] == 0
