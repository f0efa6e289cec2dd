"""Byte-pair encoding and decoding with the files of public tokenizers (byte-level, .json)."""

import hashlib
import json
import re
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm.common import kept, per_row, texts

# Fixed value: the pre-token pattern of byte-level tokenizers.
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Pre-tokens in each of the two generations that a worker remembers (about 60 MB each).
REMEMBERED = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: printable Latin-1 for itself, the
    others for code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Bpe:
    """The model in one tokenizer file.

    Merges wait in a priority queue by rank and place, over symbols linked in both
    directions. An entry whose symbols have changed since is stale and skipped.
    """

    def __init__(self, content: str):
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not (spec.get("normalizer") or model.get("unk_token") or model.get("end_of_word_suffix")
                     or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not plain:
            raise ValueError("only byte-level BPE without normalizer or affixes is supported")
        vocab, letters = model["vocab"], byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        self.width = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}  # left id * width + right id: rank of their merge
        self.made: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] * self.width + vocab[right], len(self.made))
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        byte_of = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.names = [str(i) for i in range(size)]
        self.pattern = regex.compile(PRETOKEN)
        found = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.marks = re.compile(f"({found})") if found else None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        symbol = [self.byte_ids[b] for b in piece]
        end = len(symbol)
        if end < 2:
            return tuple(symbol)
        rank, made, shift, width = self.rank.get, self.made, end.bit_length(), self.width
        mask = (1 << shift) - 1
        # an entry is rank and place in one number
        queue = [r << shift | i for i, (a, b) in enumerate(pairwise(symbol)) if (r := rank(a * width + b)) is not None]
        heapify(queue)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while queue:
            entry = heappop(queue)
            i = entry & mask
            j, left = after[i], symbol[i]
            if j == end or left < 0 or rank(left * width + symbol[j]) != entry >> shift:
                continue  # stale
            symbol[i] = new = made[entry >> shift]
            symbol[j] = -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank(new * width + symbol[k])) is not None:
                    heappush(queue, r << shift | i)
            h = before[i]
            if h >= 0 and (r := rank(symbol[h] * width + new)) is not None:
                heappush(queue, r << shift | h)
        return tuple([s for s in symbol if s >= 0])

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text in parts, each with whether it is a special token's string."""
        if self.marks is None or not any(t in text for t in self.special):
            return [(text, False)]
        return [(part, bool(i % 2)) for i, part in enumerate(self.marks.split(text)) if part]

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str, known: "Pieces") -> list[int]:
        ids: list[int] = []
        for part, special in self.segments(text):
            if special:
                ids.append(self.special[part])
            else:
                ids.extend(chain.from_iterable(map(known.__getitem__, self.pretokens(part))))
        known.trim()
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class Pieces(dict):
    """Pre-token to ids, found on first use. When full it becomes the ``old`` generation, from
    which what is still in use comes back."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = self.old.pop(piece, None) or self.bpe.merge(piece.encode())
        return ids

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


def loaded(content: str) -> tuple[Bpe, Pieces]:
    """The model of a tokenizer file and its pieces, which a worker keeps."""
    return kept(("bpe", content), lambda: (bpe := Bpe(content), Pieces(bpe)))


def shipped(spark, path: str):
    """The tokenizer file as a broadcast text (a vocabulary file, of fixed size), so that
    executors need no file of their own."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


KINDS = {
    "ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()), "decoded": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_decode(docs: DataFrame, tokenizer: str, want=("ids", "decoded"), text="text", keep=None) -> DataFrame:
    """Encode each whole text and decode its ids again.

    ``want``: columns to add, of ``ids``, ``n_tokens``, ``ids_sha256`` (of the decimal ids
    joined by commas), ``decoded`` and ``decoded_sha256``. Columns of ``docs`` in ``keep``
    (default all) are kept; one with the name of a wanted column is replaced. Strings of
    special tokens inside a text become these tokens, as the tokenizer's library does by
    default. Null and empty texts have no ids. Rows are independent: repeated rows give
    repeated results, an empty table an empty one, and no row moves to another task.
    """
    content = shipped(docs.sparkSession, tokenizer)

    def make():
        bpe, known = loaded(content.value)
        name = bpe.names.__getitem__

        def of(ids, decoded):
            for column in want:
                if column == "ids":
                    yield ids
                elif column == "n_tokens":
                    yield len(ids)
                elif column == "ids_sha256":
                    yield hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest()
                elif column == "decoded":
                    yield decoded
                else:
                    yield hashlib.sha256(decoded.encode()).hexdigest()

        def function(batch):
            rows = []
            for value in texts(batch.column(0)):
                ids = bpe.encode(value, known)
                rows.append(tuple(of(ids, bpe.decode(ids))))
            columns = list(zip(*rows)) or [[]] * len(want)
            return [pa.array(c, KINDS[w][1]) for c, w in zip(columns, want)]

        return function

    return per_row(docs, [text], ", ".join(f"{w} {KINDS[w][0]}" for w in want), make,
                   docs.columns if keep is None else keep)


def decode(df: DataFrame, tokenizer: str, ids="ids", out="decoded") -> DataFrame:
    """``df`` with the text of its token ids: the vocabulary's strings joined, and bytes that
    are no UTF-8 replaced. Null ids give the empty text."""
    content = shipped(df.sparkSession, tokenizer)

    def make():
        bpe, _ = loaded(content.value)
        return lambda batch: [pa.array([bpe.decode(v.as_py() or []) for v in batch.column(0)], pa.string())]

    return per_row(df, [ids], f"{out} string", make, df.columns)
