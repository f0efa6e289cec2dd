"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import collocations

DDL = "doc_id long, text string, lang string, a string, n string"


def by_hand(rows, max_words=3, min_count=10, inside=50, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = tuple(re.findall("[^ \t]+", piece))
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[words[i:i + k]] += 1
    out = set()
    for lang, f in counts.items():
        phrases, kept = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}, []
        for p, a in phrases.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                       for q, b in phrases.items()):
                kept.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, p, a, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), a, left, right, totals[lang], -score))
    return out


def invented(n, seed=1):
    rand = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "NEW", "é", "ß", "日本", "a\x01", "a", "b\x1f", "x" * 300]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "?!"]
    rows = []
    for i in range(n):
        text = "".join(rand.choice(words) + rand.choice(ends) for _ in range(rand.randint(0, 60)))
        if i % 3 == 0:
            text += "big red fox of the new york" * (i % 4)
        rows.append((i, text, rand.choice(["en", "en", "de", None, "und", ""]), "a", "b"))
    return rows + [(None, None, "en", None, None), (7, "", "fr", None, None), (8, "...", "it", None, None), rows[3], rows[3]]


def result(spark, rows, **options):
    out = collocations.collocations(spark.createDataFrame(rows, DDL), **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in out.collect()}


def test_phrases(spark):
    rows = invented(150)
    want = by_hand(rows)
    assert len(want) > 40 and result(spark, rows) == want


@pytest.mark.parametrize("words, least, inside, top", [(2, 3, 50, 5), (4, 4, 80, 2000), (5, 6, 101, 30)])
def test_parameters(spark, words, least, inside, top):
    rows = invented(90, words)
    assert result(spark, rows, max_words=words, min_count=least, inside_percent=inside, top=top) == by_hand(rows, words, least, inside, top)


def test_small_chunks_and_runs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 60)
    monkeypatch.setattr(collocations, "RUN_ROWS", 3)
    monkeypatch.setattr(collocations, "SAMPLED", 2)
    rows = invented(120, 4)
    assert result(spark, rows, max_words=4, min_count=5) == by_hand(rows, 4, 5)


def test_a_full_sieve_only_counts_more(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SIEVE_BITS", 15)  # one bitmap for all
    rows = invented(120, 6)
    want = by_hand(rows, 4, 4)
    assert result(spark, rows, max_words=4, min_count=4) == want
    data = bytes([255]) * 4096
    assert collocations.Sieve(data).holds(np.arange(99, dtype=np.uint64)).all()
    assert not collocations.Sieve(bytes(4096)).holds(np.arange(99, dtype=np.uint64)).any()


def test_slices_of_a_text_are_its_words(monkeypatch):
    text = "One two,three  four\tfive. six" * 20
    whole = [w for part in collocations.slices(text) for w in part]
    monkeypatch.setattr(collocations, "SLICE_BYTES", 7)
    parts = list(collocations.slices(text))
    assert len(parts) > 30 and [w for part in parts for w in part] == whole


def test_counts_beyond_64_bits(spark):
    a = 3_000_000_000
    df = spark.createDataFrame([("en", "x y", a, [a + 1], [a + 7], None)], "lang string, gram string, a long, pre array<long>, post array<long>, longer long")
    row = collocations.scored(df).first()
    assert row["score"] == 1000000 * a * a // ((a + 1) * (a + 7)) and (row["l"], row["r"]) == (a + 1, a + 7)


def test_empty_tables(spark):
    assert result(spark, []) == set()
    assert result(spark, [(1, None, None, None, None), (2, " \t\n", "en", None, None)]) == set()
