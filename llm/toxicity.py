"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy."""

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import afforded, fold_of, give_back, listed, per_row, texts
from mandigrid.session import materialise

# Rows of each label that the model is fitted on, and distinct words of their texts, at most.
SAMPLE_ROWS, SAMPLE_WORDS = 3_000, 400_000
# Character n-grams of a word between its borders, hashed into 2**BUCKET_BITS vectors.
GRAMS, BUCKET_BITS, SIZE = (3, 4, 5), 18, 8
# Words in a bag. Each of the distinct words of a text, as they first come, begins a bag; a text
# is scored by its worst bag. A bag that isn't full is averaged as if it were. Of 2, 3 and 4, two
# were best on a fold of the training rows.
BAG = 2
# Words of a group of texts that are scored together, and of them those whose n-grams are made at once.
GROUP_WORDS, SPELT_WORDS = 500_000, 5_000
# N-grams of the sample that are added up at once.
PIECE = 1 << 18


def distinct(words: list[bytes], places: dict[bytes, int]) -> np.ndarray:
    """Number of each word in ``places``, to which new words are added."""
    return np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all ``words``, and for each its word; ordered by word within
    each n. A space stands for a word's border."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), lengths)  # of each place; a space opens its word
    end = np.cumsum(lengths)[owner]  # place of the space that closes the word
    buckets, owners = [], []
    value = np.zeros(len(raw), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(raw) < n:
            break
        value = value[: len(raw) - n + 1] * np.uint32(0x01000193) + raw[n - 1:] + np.uint32(1)
        if n in GRAMS:
            place = np.flatnonzero(np.arange(min(len(owner), len(value))) + n - 1 <= end[: len(value)])
            mixed = (value[place] ^ (value[place] >> np.uint32(15))) * np.uint32(0x9E3779B1)
            buckets.append((mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))
            owners.append(owner[place])
    return np.concatenate(buckets), np.concatenate(owners)


def bags(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of each bag of a text of ``n`` words."""
    first = np.arange(max(1, n - BAG + 1))
    return first, np.minimum(first + BAG, n)


@dataclass
class Model:
    """Per bucket the difference of the two classes' logits (embeddings times softmax weights),
    and the bias."""

    bucket_logits: np.ndarray
    bias: float

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        logits = [np.zeros(0)]
        for at in range(0, len(words), SPELT_WORDS):
            part = words[at:at + SPELT_WORDS]
            bucket, owner = subwords(part)
            count = np.bincount(owner, minlength=len(part))
            logits.append(np.bincount(owner, self.bucket_logits[bucket], len(part)) / np.maximum(count, 1))
        return np.concatenate(logits)

    def scores(self, documents: Iterable[list[bytes]]) -> list[float]:
        """Of each document by its words. Documents are taken one after the other; of a group of
        them only numbers and the distinct words are held."""
        out: list[float] = []
        places: dict[bytes, int] = {}
        numbered: list[np.ndarray] = []
        held = 0
        for words in documents:
            numbered.append(distinct(words, places))
            held += len(words)
            if held > GROUP_WORDS:
                out += self.group_scores(list(places), numbered)
                places, numbered, held = {}, [], 0
        return out + self.group_scores(list(places), numbered)

    def group_scores(self, words: list[bytes], numbered: list[np.ndarray]) -> list[float]:
        logit = self.word_logits(words)
        out = []
        for numbers in numbered:
            so_far = np.concatenate([[0.0], np.cumsum(logit[numbers])])
            first, last = bags(len(numbers))
            out.append(self.bias + float((so_far[last] - so_far[first]).max()) / BAG)
        return [float(1 / (1 + np.exp(-min(max(v, -40.0), 40.0)))) for v in out]


def words_in(text: str) -> list[bytes]:
    """The distinct words of a text in lower case, in the order of their first places."""
    return list(dict.fromkeys(text.lower().encode("utf-8", "replace").split()))


@dataclass
class Sample:
    """Texts as arrays: each text's distinct words as numbers, one after the other, how many
    each has, and the n-gram buckets of each numbered word."""

    words: np.ndarray
    lengths: np.ndarray
    bucket: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, documents: list[list[bytes]]) -> "Sample":
        places: dict[bytes, int] = {}
        numbered = [distinct(words, places) for words in documents]
        bucket, owner = subwords(list(places))
        return cls(np.concatenate([*numbered, np.zeros(0, np.int64)]), np.array(list(map(len, numbered))), bucket, owner)

    @classmethod
    def joined(cls, texts: list[np.ndarray], known: np.ndarray, buckets: list[np.ndarray]) -> "Sample":
        """From the words of each text as 64-bit numbers, and the buckets of each ``known`` word."""
        return cls.spelt(texts, known, np.concatenate([*buckets, np.zeros(0, np.int32)]), np.array(list(map(len, buckets)), np.int64))

    @classmethod
    def spelt(cls, texts: list[np.ndarray], known: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> "Sample":
        """The same with the ``buckets`` of all known words in one array, and how many each has."""
        order = np.argsort(known)
        words = order[np.searchsorted(known[order], np.concatenate([*texts, np.zeros(0, np.int64)]))]
        return cls(words, np.array(list(map(len, texts))), buckets, np.repeat(np.arange(len(known), dtype=np.int32), counts))


def numbers_of(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words]), np.int64)


def bucket_lists(words: list[bytes]) -> list[np.ndarray]:
    """The n-gram buckets of each word."""
    bucket, owner = subwords(words)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(words)))
    return np.split(bucket[order].astype(np.int32), ends[:-1]) if words else []


def fit_model(sample: Sample, labels: list[int], weights: list[float], rounds=200, rate=0.1, decay=1e-4) -> Model:
    """Embeddings and softmax weights by Adam over all documents.

    A document's loss is taken at a soft maximum over its bags, which grows harder with the
    rounds: a label says only that some passage is toxic.
    """
    token = sample.words
    n_words = int(token.max()) + 1 if len(token) else 0
    per_word = np.maximum(np.bincount(sample.owner, minlength=n_words), 1)

    def pieces():
        for at in range(0, len(sample.bucket), PIECE):
            yield sample.bucket[at:at + PIECE].astype(np.intp), sample.owner[at:at + PIECE].astype(np.intp)

    first, last, doc, offset = [], [], [], 0
    for d, length in enumerate(sample.lengths):
        a, b = bags(length)
        first.append(a + offset)
        last.append(b + offset)
        doc.append(np.full(len(a), d))
        offset += length
    first, last, doc = map(np.concatenate, (first, last, doc))
    begins = np.searchsorted(doc, np.arange(len(sample.lengths)))
    y, w = np.array(labels, float), np.array(weights, float) / np.sum(weights)
    rng = np.random.default_rng(7)
    p = [np.zeros((1 << BUCKET_BITS, SIZE), np.float32), rng.normal(0, 0.5, SIZE).astype(np.float32),
         np.array([np.log((w @ y + 1e-6) / (1 - w @ y + 1e-6))], np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in p]
    for step in range(1, rounds + 1):
        embedding, weight, bias = p
        logit, by_bucket, of_bucket = np.zeros(len(per_word)), np.zeros(1 << BUCKET_BITS), (embedding @ weight).astype(float)
        for bucket, owner in pieces():
            np.add.at(logit, owner, of_bucket[bucket])
        logit /= per_word
        so_far = np.concatenate([[0.0], np.cumsum(logit[token])])
        score = bias[0] + (so_far[last] - so_far[first]) / BAG
        hard = 1.0 + 3.0 * step / rounds
        share = np.exp(hard * (score - np.maximum.reduceat(score, begins)[doc]))
        share /= np.add.reduceat(share, begins)[doc]
        value = np.add.reduceat(share * score, begins)
        slope = (1 / (1 + np.exp(-np.clip(value, -40, 40))) - y) * w
        part = slope[doc] * share / BAG
        edge = np.bincount(first, part, len(token) + 1) - np.bincount(last, part, len(token) + 1)
        by_word = np.bincount(token, np.cumsum(edge)[:-1], n_words) / per_word
        for bucket, owner in pieces():
            np.add.at(by_bucket, bucket, by_word[owner])
        by_bucket = by_bucket.astype(np.float32)
        grads = [np.outer(by_bucket, weight) + decay * embedding, embedding.T @ by_bucket, np.array([slope.sum()], np.float32)]
        for v, g, (m, s) in zip(p, grads, moments):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return Model((p[0] @ p[1]).astype(np.float32), float(p[2][0]))


def fit(docs: DataFrame, labels: DataFrame, rows=SAMPLE_ROWS, size=SAMPLE_WORDS) -> Model | None:
    """A model from labelled rows (``toxic``) whose crc32 of the id is not 2 modulo 4.

    Of each label at most ``rows`` ids of ``docs`` are used, the first by a hash, and ``size``
    distinct words of texts in all; texts too long for what is left are passed over. The rest of
    the work does not depend on this sample's size. Words become numbers in the tasks, and only
    these reach the driver. Labels that are null, or of both kinds for an id, are left out. None
    unless both labels occur; an error if no text of one fits.
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id"), 4) != 2))
           .groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).where("label = other"))
    one = materialise(one.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "label"), "toxicity-labels")
    share = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}  # two rows at most
    if len(share) < 2:
        return None
    first = [one.where(F.col("label") == v).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(first[0].union(first[1])), "doc_id").dropDuplicates(["doc_id"])

    def make():
        def function(batch):
            made = [numbers_of(words_in(t)) for t in texts(batch.column(0))]
            return [pa.array(list(map(len, made)), pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())]
        return function

    def spell(batches):
        for batch in batches:
            every = list(dict.fromkeys(w for t in texts(batch.column(0)) for w in words_in(t)))
            for at in range(0, len(every), SPELT_WORDS):
                words = every[at:at + SPELT_WORDS]
                yield pa.RecordBatch.from_arrays([pa.array(numbers_of(words)), pa.array([b.tobytes() for b in bucket_lists(words)], pa.binary())],
                                                 names=["word", "buckets"])
        give_back()

    sample = materialise(sample, "toxicity-texts")
    numbered = materialise(per_row(sample, ["text"], "n long, words binary", make, ["doc_id", "label"]), "toxicity-sample")
    order = (F.xxhash64("doc_id", F.lit(1)), F.col("doc_id"))
    sizes = [tuple(r) for r in numbered.select("doc_id", "label", "n").orderBy(*order).collect()]  # bounded by the sample
    ids, label_of = afforded(sizes, size), {i: label for i, label, _ in sizes}
    lost = {0, 1} - {label_of[i] for i in ids}
    if lost:
        raise ValueError(f"no text of label {sorted(lost)} fits into {size} words")
    wanted = F.broadcast(listed(docs.sparkSession, ids, sample.schema["doc_id"]))
    found = numbered.join(wanted, "doc_id").select("doc_id", "words").toArrow()  # ``size`` words
    spelt = (sample.join(wanted, "doc_id").select("text").mapInArrow(spell, "word long, buckets binary")
             .dropDuplicates(["word"]).toArrow())
    rows = sorted(zip(found["doc_id"].to_pylist(), found["words"].to_pylist()), key=lambda r: str(r[0]))
    made = Sample.spelt([np.frombuffer(w, np.int64) for _, w in rows], *spelling(spelt))
    ys = [label_of[i] for i, _ in rows]
    weights = [share[v] ** 0.5 / ys.count(v) for v in (0, 1)]  # between their shares and equal ones
    del found, spelt, rows
    give_back()
    model = fit_model(made, ys, [weights[v] for v in ys])
    del made
    give_back()
    return model


def spelling(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers in order, the buckets of all of them in one array, and how many each has,
    of a table of ``word`` and ``buckets``."""
    table = table.sort_by("word")
    flat = [np.zeros(0, np.int32)]
    for at in range(0, len(table), SPELT_WORDS):
        flat.append(np.frombuffer(b"".join(table["buckets"].slice(at, SPELT_WORDS).to_pylist()), np.int32))
    return table["word"].to_numpy(), np.concatenate(flat), pc.binary_length(table["buckets"]).to_numpy().astype(np.int64) // 4


def score(docs: DataFrame, model: Model | None, keep=None, cut=0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``cut`` on).

    Whole texts are scored, in one pass without a shuffle. A text without words has the score
    of the bias alone; without a model all scores are 0. Repeated rows score alike.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]

    def make():
        def function(batch):
            values = model.scores(map(words_in, texts(batch.column(0)))) if model else [0.0] * len(batch)
            return [pa.array(values, pa.float64())]

        return function

    out = per_row(docs, ["text"], "score double", make, keep)
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
