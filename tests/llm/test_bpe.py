"""Encoding, decoding and token counts against the tokenizer's own library."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "\n\n  x", "a", "Hello world, it's me", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|>", "x\x85y\x1cz\x00",
    "日本語 ½² ٣٤", "👩‍👩‍👧 é", "ab" * 5000, "z" * 3000, "\t\r\n", "don't 'LL I'LL", "  lead and trail  ", "same", "same",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def odd(spark):
    rows = [(i if i != 3 else None, t, "own", "id") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, decoded string, `k0` string")


def test_ids_and_text_are_those_of_the_library(odd, library):
    got = {r["text"]: r for r in bpe.encode_decode(odd, PATH, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()}
    for text in ODD:
        ids, row = library.encode(text or "", add_special_tokens=False).ids, got[text]
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded"] == (text or "") == library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_columns_are_kept_and_clashing_names_replaced(odd):
    out = bpe.encode_decode(odd, PATH)
    assert out.columns == ["doc_id", "text", "k0", "ids", "decoded"]
    assert out.count() == len(ODD)
    assert {r["k0"] for r in out.collect()} == {"id"}


def test_decode_replaces_broken_bytes(spark, library):
    ids = library.encode("é", add_special_tokens=False).ids + [library.encode("日本", add_special_tokens=False).ids[0]]
    df = spark.createDataFrame([(ids,), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, PATH).collect()] == [library.decode(ids), "", ""]


def test_generations_of_remembered_pieces():
    model = bpe.Bpe(open(PATH, encoding="utf-8").read())
    known = bpe.Pieces(model)
    first = model.encode("one two three", known)
    known.old, _ = dict(known), known.clear()
    assert model.encode("one two three", known) == first and not known.old


def test_token_counts(odd, library):
    got = sorted(token_counts.count_tokens(odd, PATH, limit=5).collect(), key=str)
    want = []
    for i, text in enumerate(ODD):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i if i != 3 else None, len((text or "").encode()), n, n > 5))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_counts_do_not_depend_on_chunks(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 40)
    rows = [(i, f"row {i % 7} of words and words {i}") for i in range(60)]
    out = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {i: len(library.encode(t).ids) for i, t in rows}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(empty, PATH).count() == 0
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
