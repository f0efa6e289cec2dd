"""The transducer against the tokenizer's own library, and its decoder against Python's."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from llm import transducer

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", None, " ", "\n\n  x", "a", "Hello world, it's me", "<|endoftext|>", "x\x85y\x1cz\x00", "日本語 ½² ٣٤", "👩‍👩‍👧 é",
    "ab" * 5000, "z" * 30000, "\t\r\n", "don't 'LL I'LL", "  lead and trail  ", "same", "same", "word " * 20000,
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="ascii") as file:
        return transducer.Model(file.read(), public_tokenizers.PATTERN)


def pieces(strings, n):
    """Strings of tokens, of few letters, of repeated tokens and of any bytes."""
    rand = random.Random(3)
    for k in range(n):
        kind = k % 4
        if kind == 0:
            yield b"".join(rand.choice(strings) for _ in range(rand.randint(1, 6)))
        elif kind == 1:
            yield bytes(rand.choice(b"aeist nr") for _ in range(rand.randint(1, 50)))
        elif kind == 2:
            yield (rand.choice(strings) * rand.randint(1, 20))[:150]
        else:
            yield bytes(rand.randrange(256) for _ in range(rand.randint(1, 30)))


def test_ids_of_any_bytes_are_those_of_the_library(model, library):
    for piece in pieces(model.transducer.strings, 6000):
        assert list(model.transducer.encode(piece)) == library._encode_single_piece(piece)


def test_states_may_be_forgotten_at_any_place(model, library, monkeypatch):
    for limit in (1, 2, 7):
        monkeypatch.setattr(transducer, "STATES", limit)
        for piece in pieces(model.transducer.strings, 60):
            assert list(model.transducer.encode(piece)) == library._encode_single_piece(piece)


def test_ids_come_out_as_soon_as_they_are_certain(model):
    read = []

    def letters():
        for byte in b"international standardisation " * 4:
            read.append(byte)
            yield bytes([byte])

    waited = []
    out, given = [], 0
    for token in model.transducer.stream(letters()):
        out.append(token)
        given += len(model.transducer.strings[token])
        waited.append(len(read) - given)
    assert tuple(out) == model.transducer.encode(b"international standardisation " * 4)
    assert max(waited) <= max(map(len, model.transducer.strings))


def test_streaming_decode_is_that_of_python(model):
    rand, strings = random.Random(5), model.transducer.strings
    for _ in range(3000):
        ids = [rand.choice((rand.randrange(len(strings)), rand.randrange(256))) for _ in range(8)]
        raw = b"".join(strings[i] for i in ids)
        assert model.characters.decode(ids) == raw.decode("utf-8", "replace")
        begun, first = model.characters.stream(ids[:4])
        begun, second = model.characters.stream(ids[4:], begun)
        assert first + second + ("�" if begun else "") == raw.decode("utf-8", "replace")


def test_texts(spark, library):
    rows = [(i if i != 3 else None, t, "own", "id") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, `k0` string")
    out = transducer.encode_decode(df, PATH, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"))
    assert out.columns == ["doc_id", "text", "k0", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]
    got = out.collect()
    assert len(got) == len(ODD)
    for row in got:
        text = row["text"] or ""
        ids = library.encode_ordinary(text)
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == text
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    again = transducer.decode(out.drop("decoded"), PATH)
    assert all(r["decoded"] == (r["text"] or "") for r in again.collect())


def test_little_room_changes_nothing(spark, library, monkeypatch, model):
    monkeypatch.setattr(transducer, "REMEMBERED_BYTES", 300)
    monkeypatch.setattr(transducer, "BLOCK", 3)
    for text in filter(None, ODD):
        assert [i for ids in model.blocks(text) for i in ids] == library.encode_ordinary(text)


def test_empty_table_and_wrong_files(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert transducer.encode_decode(empty, PATH).count() == 0
    line = lambda token, rank: f"{base64.b64encode(token).decode()} {rank}"
    letters = [line(bytes([b]), b) for b in range(256)]
    with pytest.raises(ValueError):
        transducer.Transducer("\n".join(letters[1:]))
    with pytest.raises(ValueError):  # "abc" comes before what it is made of
        transducer.Transducer("\n".join([*letters, line(b"abc", 256), line(b"ab", 257)]))
