"""Language-model scores by deleted interpolation of word n-grams."""

import hashlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from llm.common import packed, unpacked, words_of
from mandigrid.session import materialise

# Bytes of text in a chunk, and n-grams that one group of the count handles, about.
CHUNK_BYTES, GROUP_GRAMS = 16 << 20, 1 << 20
# Kinds of chunks: counted, held out to learn the weights, scored only.
COUNTED, HELD, SCORED = range(3)
# Classes of contexts by the binary logarithm of their frequency; 0: never seen.
CLASSES = 24
# Steps of the histogram for expectation-maximisation in an octave of probability.
STEPS = 8
END = b""  # the end of a text, and the context of its first word; no word is empty

_ONE = np.uint64(1)


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(29))


@dataclass
class Grams:
    """The distinct unigrams and bigrams of a chunk, by 64-bit keys in order. The last bit of
    a key is 1 for unigrams."""

    keys: np.ndarray
    counts: np.ndarray
    word: np.ndarray  # of each token: place of its unigram among the keys
    context: np.ndarray  # the same for the token before
    pair: np.ndarray  # place of its bigram
    starts: np.ndarray  # first token of each document


def grams_of(chunk: dict) -> Grams:
    spans = np.array(chunk["spans"], np.int64)
    tokens = unpacked(chunk["tokens"], int(spans.sum())).astype(np.int64)
    hashes = np.frombuffer(chunk["hashes"], "<u8")
    starts = np.cumsum(spans) - spans
    before = np.concatenate([[0], tokens[:-1]])
    before[starts] = 0  # the end of text has number 0
    pairs = mixed(mixed(hashes[before]) + hashes[tokens]) & ~_ONE
    keys, places = np.unique(np.concatenate([pairs, mixed(hashes) | _ONE]), return_inverse=True)
    pair, unigram = places[: len(tokens)], places[len(tokens):]
    counts = np.bincount(pair, minlength=len(keys))
    counts[unigram] += np.bincount(tokens, minlength=len(hashes))
    return Grams(keys, counts, unigram[tokens], unigram[before], pair, starts)


class Chunk:
    def __init__(self, kind: int):
        self.kind, self.ids, self.spans, self.bytes = kind, [], array("q"), 0
        self.places, self.tokens = {END: 0}, array("I")

    def add(self, doc_id, words: list[bytes], size: int) -> None:
        places = self.places
        self.tokens.extend([places.setdefault(w, len(places)) for w in words])
        self.tokens.append(0)
        self.ids.append(doc_id)
        self.spans.append(len(words) + 1)
        self.bytes += size

    def row(self, name: int) -> list:
        hashes = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in self.places)
        return [[name], [self.kind], [self.ids], [list(self.spans)], [packed(np.array(self.tokens))], [hashes]]


def gather(docs: DataFrame) -> DataFrame:
    """Chunks of the documents (doc_id, text, kind), each of one kind; the texts are read once."""
    made = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()),
        T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("tokens", T.BinaryType()), T.StructField("hashes", T.BinaryType())])
    arrow = to_arrow_schema(made)

    def run(batches):
        number, chunks = TaskContext.get().partitionId() << 32, [Chunk(k) for k in range(3)]
        done = lambda chunk: pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(chunk.row(number), arrow)], schema=arrow)
        for batch in batches:
            for doc_id, text, kind in zip(*batch.columns):
                text, kind = text.as_py() or "", kind.as_py()
                chunks[kind].add(doc_id.as_py(), words_of(text, True), len(text))
                if chunks[kind].bytes >= CHUNK_BYTES:
                    yield done(chunks[kind])
                    number, chunks[kind] = number + 1, Chunk(kind)
        for chunk in chunks:
            if chunk.ids:
                yield done(chunk)
                number += 1

    return materialise(docs.select("doc_id", "text", "kind").mapInArrow(run, made), "lm-chunks")


COUNTS = "chunk long, kind int, part int, size int, counted binary, held binary, known long, known_counted long"


def count_grams(chunks: DataFrame, parts: int) -> DataFrame:
    """How often each n-gram of each chunk occurs in all counted and in all held-out chunks.

    A chunk sends each of its n-grams once, in ``parts`` parts by the leading bits of the
    keys, so that neither frequent words nor repeated texts make a part larger than others.
    Rows with chunk -1 hold the numbers of distinct words in a part.
    """
    shift = np.uint64(64 - parts.bit_length() + 1) if parts > 1 else None

    sent_schema = "part int, chunk long, kind int, size int, keys binary, counts binary"
    sent_arrow = to_arrow_schema(T.StructType.fromDDL(sent_schema))

    def send(batches):
        for batch in batches:
            for chunk in batch.to_pylist():
                grams = grams_of(chunk)
                part = (grams.keys >> shift).astype(np.int64) if shift else np.zeros(len(grams.keys), np.int64)
                at = np.searchsorted(part, np.arange(parts + 1))
                rows = [(int(k), chunk["chunk"], chunk["kind"], int(b - a), packed(np.diff(grams.keys[a:b], prepend=np.uint64(0)), 8),
                         packed(grams.counts[a:b])) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), sent_arrow)], schema=sent_arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(COUNTS))

    def add(table):
        rows = table.to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["size"], 8), dtype=np.uint64) for r in rows])
        kind = np.repeat([r["kind"] for r in rows], [r["size"] for r in rows])
        counts = np.concatenate([unpacked(r["counts"], r["size"]) for r in rows]).astype(np.float64)
        distinct, place = np.unique(keys, return_inverse=True)
        total = [np.bincount(place, counts * (kind == k), len(distinct)).astype(np.int64) for k in (COUNTED, HELD)]
        word = (distinct & _ONE).astype(bool)
        out, begin = [], 0
        for r in rows:
            own = place[begin:begin + r["size"]]
            begin += r["size"]
            out.append((r["chunk"], r["kind"], r["part"], r["size"], packed(total[0][own]), packed(total[1][own]), None, None))
        out.append((-1, None, rows[0]["part"], 0, None, None, int((word & (total[0] + total[1] > 0)).sum()), int((word & (total[0] > 0)).sum())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    sent = chunks.select("chunk", "kind", "spans", "tokens", "hashes").mapInArrow(
        send, sent_schema)
    return materialise(sent.groupBy("part").applyInArrow(add, COUNTS), "lm-counts")


def counts_of(rows: list[dict], column: str) -> np.ndarray:
    """The counts of a chunk's keys, in their order."""
    return np.concatenate([unpacked(r[column], r["size"]) for r in sorted(rows, key=lambda r: r["part"])]).astype(np.int64)


def context_class(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, CLASSES), 0)


def steps(p: np.ndarray) -> np.ndarray:
    """Logarithm of a probability in whole steps; 1 for probability 0."""
    return np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)


def histogram(chunks: DataFrame, counts: DataFrame, tokens: int) -> DataFrame:
    """Held-out tokens by context class and by their probabilities as bigram and unigram,
    taken from the counted chunks. Its cells are bounded in number, whatever the input."""
    def run(counted, chunk):
        cells, weights = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        rows = counted.to_pylist()
        for c in chunk.to_pylist():
            grams, n = grams_of(c), counts_of(rows, "counted")
            context, pair, word = n[grams.context], n[grams.pair], n[grams.word]
            cell = np.stack([context_class(context), steps(pair / np.maximum(context, 1)), steps(word / max(tokens, 1))], 1)
            cells, weights = np.unique(cell, axis=0, return_counts=True)
        return pa.table({"class": cells[:, 0], "pair": cells[:, 1], "word": cells[:, 2], "n": weights})

    held = chunks.where(F.col("kind") == HELD)
    by = counts.where(F.col("kind") == HELD).select("chunk", "part", "size", "counted").groupBy("chunk")
    cells = by.cogroup(held.groupBy("chunk")).applyInArrow(run, "class long, pair long, word long, n long")
    return cells.groupBy("class", "pair", "word").agg(F.sum("n").alias("n"))


def learn_weights(cells: list[tuple[int, int, int, int]], words: int, rounds=200) -> np.ndarray:
    """Weights of bigram, unigram and uniform distribution for each context class, by
    expectation-maximisation; a class without events takes those of the next lower one."""
    weights = np.tile([0.0, 0.8, 0.2], (CLASSES + 1, 1))
    data = np.array(cells, float).reshape(-1, 4)
    for c in range(CLASSES + 1):
        own = data[data[:, 0] == c]
        if not len(own):
            if c:
                weights[c] = weights[c - 1] if c > 1 else [0.3, 0.6, 0.1]
            continue
        p = np.stack([np.where(own[:, k] < 1, 2.0 ** (own[:, k] / STEPS), 0.0) for k in (1, 2)] + [np.full(len(own), 1 / (words + 1))], 1)
        w = np.array([0.4, 0.4, 0.2]) if c else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (share * own[:, 3:]).sum(0) / own[:, 3].sum()
        w = np.maximum(w, [0.0, 1e-9, 1e-9])
        weights[c] = w / w.sum()
    return weights


def score(docs: DataFrame, kind, keep="doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each document.

    ``kind`` is a column: COUNTED and HELD documents are learned from, SCORED ones are not.
    Probability of a word after its context: maximum-likelihood estimates of bigram and
    unigram, and the uniform distribution over the known words and one more, in a mixture
    whose weights depend on the context's frequency. The weights are learned on the HELD
    documents against counts of the COUNTED ones; the scores use the counts of both.
    ``base_score`` is that of the unigrams with half a count added.

    The counts are those of all documents, and are shuffled once, each n-gram once a chunk;
    no n-gram is left out. Null and empty texts are one end token. Repeated rows are counted
    and scored each. Without documents to learn from, all words are unknown.
    """
    fed = docs.select(F.col(f"`{keep}`").alias("doc_id"), F.col("text"), kind.cast("int").alias("kind"))
    chunks = gather(fed)
    size = F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")
    tokens = {r["kind"]: r["n"] for r in chunks.groupBy("kind").agg(size).collect()}  # three rows at most
    grams = sum(tokens.values())
    parts = 1 << max(0, (grams // GROUP_GRAMS).bit_length())
    counts = count_grams(chunks, parts)
    known = counts.where("chunk = -1").agg(F.sum("known").alias("all"), F.sum("known_counted").alias("counted")).first()
    counted, words = tokens.get(COUNTED, 0), known["all"] or 0
    cells = histogram(chunks, counts, counted).collect()  # bounded by the classes and steps
    weights = learn_weights([tuple(r) for r in cells], known["counted"] or 0)
    total = counted + tokens.get(HELD, 0)
    kept = chunks.schema["ids"].dataType.elementType
    made = T.StructType([T.StructField("doc_id", kept), *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])
    arrow = to_arrow_schema(made)

    def run(counted_rows, chunk):
        columns = [[], [], [], [], []]
        rows = counted_rows.to_pylist()
        for c in chunk.to_pylist():
            grams, n = grams_of(c), counts_of(rows, "counted") + counts_of(rows, "held")
            context, pair, word = n[grams.context], n[grams.pair], n[grams.word]
            w = weights[context_class(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(total, 1) + w[:, 2] / (words + 1)
            base = np.log10((word + 0.5) / (total + 0.5 * (words + 1)))
            columns[0] += c["ids"]
            columns[1] += c["spans"]
            for k, v in ((2, (word > 0).astype(np.int64)), (3, base), (4, np.log10(p))):
                columns[k] += np.add.reduceat(v, grams.starts).tolist()
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)

    by = counts.where("chunk >= 0").select("chunk", "part", "size", "counted", "held").groupBy("chunk")
    return by.cogroup(chunks.groupBy("chunk")).applyInArrow(run, made).select(
        "doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
