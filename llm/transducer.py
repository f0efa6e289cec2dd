"""Byte-level BPE as a finite-state transducer, determinised while it runs, for files of ranks (.tiktoken).

A sequence of tokens is the encoding of its bytes exactly if no merge crosses any boundary
between two neighbours. So the possible cuts of a prefix are a nondeterministic transducer over
the tokens' trie, and encoding is a walk through its determinisation.
"""

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from llm.common import kept, per_row, texts

# Bytes of pre-tokens in each of two generations that a worker remembers.
REMEMBERED_BYTES = 64 << 20
# States of the automaton that a worker keeps; when full, it forgets all and goes on.
STATES = 400_000
# Characters of a text, or pre-tokens of a longer one, that are looked at together.
BLOCK = 65_536
# Tokens below a place in the trie that are looked at to give up a cut early.
LOOK = 16
ON, END = 1, 2
NEVER = 1 << 62


class Merges:
    """Ranks, and what follows from them: where a token's last merge joined it, and which
    tokens can't stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("each byte must be a token")
        self.ranks, self.halves = ranks, {}
        for token, rank in ranks.items():
            if len(token) > 1:
                halves = self._last_merge(token)
                # then merges happen in the order of their ranks, on both sides of a boundary
                if halves is None or any(len(h) > 1 and ranks[h] > rank for h in halves):
                    raise ValueError(f"token {rank} is not made of two earlier ones")
                self.halves[token] = halves
        self._edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}

    def _last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                return None  # other merges than those of the token itself
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The symbols that stand at the left (0) or right (1) end of ``token`` in turn while it
        is merged, each with the rank of the merge that ends it."""
        key = (token, side)
        if key not in self._edges:
            chain, end, at = [], NEVER, token
            while True:
                chain.append((at, end))
                if len(at) == 1:
                    break
                at, end = self.halves[at][side], self.ranks[at]
            self._edges[key] = chain[::-1]
        return self._edges[key]

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether the boundary between two tokens is one that no merge crosses."""
        xs, ys, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            rank = self.ranks.get(x + y, NEVER)
            if rank < x_ends and rank <= y_ends:  # of equal ranks the leftmost merge is first
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes in, token ids out.

    A state is a set of possible cuts of what was read and not yet emitted: the last token
    emitted, and for each cut its tokens since and its place in the trie. ``step`` follows one
    byte; tokens on which all cuts agree are emitted. There is at most one cut for each boundary
    within reach of the longest token, so what is waited for is bounded by the vocabulary.
    States are made when they are first reached. All is kept as numbers and tuples of numbers.
    """

    def __init__(self, content: str):
        rows = [line.split() for line in content.splitlines() if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.merges = Merges(ranks)
        self.strings = [b""] * (max(ranks.values()) + 1)
        self.child: dict[int, int] = {}  # node * 256 + byte: node
        for token, rank in ranks.items():
            self.strings[rank], node = token, 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.child) + 1)
        self.token = [-1] * (len(self.child) + 1)  # the token that ends at each node
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.child[node << 8 | byte]
            self.token[node] = rank
        inner = {key >> 8 for key in self.child}
        # node * 256 + byte: node, whether tokens go on (ON) or end there (END), token
        self.edges = {key: (node, ON * (node in inner) | END * (self.token[node] >= 0), self.token[node])
                      for key, node in self.child.items()}
        self.below = self._few_below()
        self.known: dict[int, int] = {}  # last token * nodes + node: what of ON and END can be after it
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = [(-1, (), 0)]  # after, then tokens and node of each cut
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple]] = {}  # state * 256 + byte: state and tokens emitted

    def _few_below(self) -> dict[int, list[int]]:
        """The tokens below each inner node that has at most LOOK of them."""
        below: dict[int, list[int]] = {}
        for key, node in reversed(self.child.items()):  # children have higher numbers than their parents
            own = below.get(node, []) + ([self.token[node]] if self.token[node] >= 0 else [])
            up = below.setdefault(key >> 8, [])
            if len(up) <= LOOK:
                up += own
        return {node: tokens for node, tokens in below.items() if len(tokens) <= LOOK}

    def _can(self, last: int, node: int, has: int) -> int:
        """What of ``has`` is left after the token ``last``: whether the token at ``node`` can
        follow it, and some token below; the latter isn't looked for if there are many."""
        if len(self.known) > 5 * STATES:
            self.known.clear()
        apart, strings = self.merges.apart, self.strings
        left = strings[last]
        if has & END and not apart(left, strings[self.token[node]]):
            has -= END
        tokens = self.below.get(node)
        if has & ON and tokens is not None and not any(apart(left, strings[t]) for t in tokens):
            has -= ON
        self.known[last * len(self.token) + node] = has
        return has

    def step(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after ``byte`` and the tokens it emits."""
        state = self.states[at]
        after, edge, known, nodes = state[0], self.edges.get, self.known.get, len(self.token)
        cuts, closed, agree, out = [], None, True, ()
        for k in range(1, len(state), 2):
            found = edge(state[k + 1] << 8 | byte)
            if found is None:
                continue
            node, can, token = found
            waiting = state[k]
            last = waiting[-1] if waiting else after
            if last >= 0:
                left = known(last * nodes + node)
                can = self._can(last, node, can) if left is None else left
            if can & ON:
                cuts += (waiting, node)
                agree = agree and waiting
            if can & END:  # what was read has one encoding only
                closed = (*waiting, token)
        if closed is not None:
            cuts += (closed, 0)
        if agree:
            first = cuts[0]
            n = len(first)
            for k in range(2, len(cuts), 2):
                other, m = cuts[k], 0
                n = min(n, len(other))
                while m < n and other[m] == first[m]:
                    m += 1
                n = m
            if n:
                out, after = first[:n], first[n - 1]
                cuts[::2] = [waiting[n:] for waiting in cuts[::2]]
        key = (after, *cuts)
        to = self.number.get(key)
        if to is None:
            if len(self.states) >= STATES:
                self._forget()
                if key == self.states[0]:
                    return 0, out
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if len(self.states) == 2:
                return to, out  # the move's own state is forgotten
        made = self.moves[at << 8 | byte] = (to, out)
        return made

    def rest(self, at: int) -> tuple[int, ...]:
        """The tokens that the end of the input sets free."""
        state = self.states[at]
        return next(state[k] for k in range(1, len(state), 2) if state[k + 1] == 0)

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of the bytes of one pre-token that come in any pieces; each id as soon as it is certain."""
        at = 0
        for chunk in chunks:
            for byte in chunk:
                at, out = self.moves.get(at << 8 | byte) or self.step(at, byte)
                yield from out
        yield from self.rest(at)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        at, ids, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(at << 8 | byte)
            if move is None:
                move = self.step(at, byte)
                moves = self.moves
            at, out = move
            if out:
                ids += out
        ids += self.rest(at)
        return tuple(ids)


def lead(byte: int) -> int:
    """Bytes of a character that begins with ``byte``; 0 if none does."""
    return 1 if byte < 0x80 else 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 0


# Fixed value: second bytes of UTF-8 that are narrower than 0x80 to 0xBF.
SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class Characters:
    """UTF-8 read token by token. A state is the begun character's bytes (three at most); what a
    token gives in a state, and the state after it, are found on first use."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.known: dict[bytes, dict[int, tuple[bytes, str]]] = {}

    @staticmethod
    def byte(begun: bytes, byte: int) -> tuple[bytes, str]:
        given = ""
        if begun:
            low, high = SECOND.get(begun[0], (0x80, 0xBF)) if len(begun) == 1 else (0x80, 0xBF)
            if low <= byte <= high:
                whole = begun + bytes([byte])
                return (b"", whole.decode()) if len(whole) == lead(begun[0]) else (whole, "")
            begun, given = b"", "�"  # what was begun stays broken; the byte is read anew
        need = lead(byte)
        return (b"", given + (chr(byte) if need else "�")) if need < 2 else (bytes([byte]), given)

    def token(self, begun: bytes, token: int) -> tuple[bytes, str]:
        state, out = begun, []
        for byte in self.strings[token]:
            state, text = self.byte(state, byte)
            out.append(text)
        made = self.known[begun][token] = (state, "".join(out))
        return made

    def stream(self, ids: Iterable[int], begun: bytes = b"") -> tuple[bytes, str]:
        """(begun bytes, text) after ``ids``."""
        known, out = self.known, []
        here = known.setdefault(begun, {})
        for i in ids:
            state, text = here.get(i) or self.token(begun, i)
            out.append(text)
            if state != begun:
                begun, here = state, known.setdefault(state, {})
        return begun, "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        begun, text = self.stream(ids)
        return text + ("�" if begun else "")


class Pieces(dict):
    """Pre-token to ids, found on first use. When full it becomes the ``old`` generation, from
    which what is still in use comes back."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.bytes = transducer, 0
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        ids = self[piece] = self.old.pop(piece, None) or self.transducer.encode(raw)
        self.bytes += 150 + len(raw) + 8 * len(ids)
        return ids

    def trim(self) -> None:
        if self.bytes > REMEMBERED_BYTES:
            self.old, self.bytes = dict(self), 0
            self.clear()


class Model:
    """Transducer, decoder and pre-token pattern, with the pre-tokens that are remembered."""

    def __init__(self, content: str, pattern: str):
        self.transducer = Transducer(content)
        self.characters = Characters(self.transducer.strings)
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(self.transducer)
        self.names = [str(i) for i in range(len(self.transducer.strings))]

    def blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text``; of a long one, a block of pre-tokens after the other."""
        if len(text) <= BLOCK:
            found = iter(self.pattern.findall(text))
        else:
            found = (m.group() for m in self.pattern.finditer(text))
        while ids := list(chain.from_iterable(map(self.pieces.__getitem__, islice(found, BLOCK)))):
            self.pieces.trim()
            yield ids


def loaded(content: str, pattern: str) -> Model:
    """The model of a file and a pattern, which a worker keeps."""
    return kept(("ranks", content, pattern), lambda: Model(content, pattern))


def shipped(spark, path: str):
    """The file of ranks as a broadcast text: a vocabulary, of fixed size."""
    with open(path, encoding="ascii") as file:
        return spark.sparkContext.broadcast(file.read())


KINDS = {
    "ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()),
    "decoded": ("string", pa.string()), "decoded_sha256": ("string", pa.string()),
}


def encode_decode(docs: DataFrame, ranks: str, want=("ids", "decoded"), text="text", keep=None,
                  pattern=public_tokenizers.PATTERN) -> DataFrame:
    """Encode each whole text by the file ``ranks`` and decode its ids again.

    Each match of ``pattern`` is encoded by itself, without special tokens. ``want``: columns
    to add, of ``ids``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded`` and ``decoded_sha256``. Columns of ``docs`` in ``keep`` (default all) are kept;
    one with the name of a wanted column is replaced. Null and empty texts have no ids and
    decode to the empty text. Texts are read, digested and decoded in blocks, so a very long
    one costs no more than its own size (and its ids, if these are wanted). Rows are
    independent: repeated rows give repeated results, an empty table an empty one, and no row
    moves to another task.
    """
    content = shipped(docs.sparkSession, ranks)

    def make():
        model = loaded(content.value, pattern)
        names = model.names.__getitem__

        def row(value):
            n, begun, ids_sum, text_sum, all_ids, all_text = 0, b"", hashlib.sha256(), hashlib.sha256(), [], []
            for ids in model.blocks(value):
                begun, part = model.characters.stream(ids, begun)
                ids_sum.update((("," if n else "") + ",".join(map(names, ids))).encode())
                text_sum.update(part.encode())
                n += len(ids)
                if "ids" in want:
                    all_ids += ids
                if "decoded" in want:
                    all_text.append(part)
            return {"ids": all_ids, "n_tokens": n, "ids_sha256": ids_sum.hexdigest(), "decoded": "".join(all_text),
                    "decoded_sha256": text_sum.hexdigest()}

        def function(batch):
            rows = [row(value) for value in texts(batch.column(0))]
            return [pa.array([r[w] for r in rows], KINDS[w][1]) for w in want]

        return function

    return per_row(docs, [text], ", ".join(f"{w} {KINDS[w][0]}" for w in want), make, docs.columns if keep is None else keep)


def decode(df: DataFrame, ranks: str, ids="ids", out="decoded") -> DataFrame:
    """``df`` with the text of its token ids, bytes that are no UTF-8 replaced; null ids give the
    empty text."""
    content = shipped(df.sparkSession, ranks)

    def make():
        characters = Characters(loaded(content.value, public_tokenizers.PATTERN).transducer.strings)
        return lambda batch: [pa.array([characters.decode(v.as_py() or []) for v in batch.column(0)], pa.string())]

    return per_row(df, [ids], f"{out} string", make, df.columns)
