"""Phrase collocations from count streams in prefix and suffix order, merged in lockstep."""

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mandigrid.session import materialise

# Bytes of text whose n-grams are counted together before they are sent on.
CHUNK_BYTES = 8 << 20
# Bytes of one text that are words in memory at once.
SLICE_BYTES = 1 << 20
# Rows of a run of a count stream, and sampled rows for each that runs are cut at.
RUN_ROWS, SAMPLED = 60_000, 32
# Bits of the filter for longer n-grams, at most.
SIEVE_BITS = 28
# Rows that are handed over at once.
BATCH_ROWS = 50_000

# Delimiters of pieces become a full stop, tabs become spaces.
_CUT = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
STOP = b"."


class Sieve:
    """A Bloom filter of n-grams of one length: it may let through others, never loses one."""

    PROBES = 4

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)

    @staticmethod
    def places(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        step = (values >> np.uint64(32)) | np.uint64(1)
        for k in range(Sieve.PROBES):
            yield (values + np.uint64(k) * step) & np.uint64(bits - 1)

    def holds(self, values: np.ndarray) -> np.ndarray:
        found = np.ones(len(values), bool)
        for place in self.places(values, 8 * len(self.bytes)):
            found &= (self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def word_values(lang: str, words: list[bytes]) -> np.ndarray:
    """64 bits for each word of a language."""
    head = f"{lang}\n".encode("utf-8", "replace")
    return np.frombuffer(b"".join([hashlib.blake2b(head + w, digest_size=8).digest() for w in words]), np.uint64)


def window_values(values: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each sequence of ``size`` words."""
    count = max(len(values) - size + 1, 0)
    mixed = np.full(count, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ values[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


class Counter:
    """The n-grams of one language in a chunk of texts. Words are numbered as they come; 0 is
    the border of a piece."""

    def __init__(self, lang: str, most: int, before: list[bytes] = ()):
        self.lang, self.most = lang, most
        self.places: dict[bytes, int] = {STOP: 0}
        self.tokens = array("I", [self.places.setdefault(w, len(self.places)) for w in before])
        self.skip = len(self.tokens)  # these were counted before; they only begin what is to come

    def add(self, words: list[bytes]) -> None:
        places = self.places
        self.tokens.extend([places.setdefault(w, len(places)) for w in words])

    def tail(self) -> list[bytes]:
        """The last words, with which n-grams of the next chunk may begin."""
        words = list(self.places)
        return [words[i] for i in self.tokens[max(0, len(self.tokens) - self.most + 1):]]

    def counts(self, sizes, sieve: Sieve | None) -> Iterator[tuple[pa.Array, pa.Array]]:
        """n-grams of each of ``sizes`` and how often they occur; none that holds a sequence
        one word shorter which the sieve doesn't."""
        tokens = np.frombuffer(self.tokens, np.uint32) if self.tokens else np.zeros(0, np.uint32)
        words = pa.array(list(self.places), pa.binary()).cast(pa.string())
        for size in sizes:
            count = max(len(tokens) - size + 1, 0)
            fit = np.ones(count, bool)
            for k in range(size):
                fit &= tokens[k:k + count] > 0
            fit[:max(self.skip - size + 1, 0)] = False
            if sieve is not None:
                own = sieve.holds(window_values(word_values(self.lang, list(self.places))[tokens], size - 1))
                fit &= own[:count] & own[1:count + 1]
            at = np.flatnonzero(fit)
            keys, parts = tokens[at].astype(np.int64), []
            for k in range(1, size):
                if k > 1:  # the beginnings get numbers, so that a key fits into 64 bits
                    keys, place = np.unique(keys, return_inverse=True)
                    parts = ([p[keys >> 32] for p in parts] or [keys >> 32]) + [keys & 0xFFFFFFFF]
                    keys = place
                keys = keys << 32 | tokens[at + k]
            found, n = np.unique(keys, return_counts=True)
            last = found & 0xFFFFFFFF
            parts = ([p[found >> 32] for p in parts] or [found >> 32]) if size > 1 else []
            taken = [words.take(pa.array(p)) for p in [*parts, last]]
            yield taken[0] if size == 1 else pc.binary_join_element_wise(*taken, " "), pa.array(n)
            if size == 1:
                yield pa.array([""]), pa.array([int(n.sum())])


def slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists of bounded size; a stop between pieces."""
    raw = text.encode("utf-8", "replace").lower().translate(_CUT)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].replace(STOP, b" . ").split()
        at = end
    yield [STOP]


def count_ngrams(docs: DataFrame, sizes: tuple[int, ...], sieve=None) -> DataFrame:
    """lang, gram and n: how often each sequence of so many words occurs within pieces. With
    size 1 the empty sequence has the number of words. ``sieve``: a broadcast Sieve's bytes.

    A chunk of texts is counted before anything is sent, so a frequent n-gram is one row a
    chunk. A chunk may end in the middle of a text.
    """
    arrow, most = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]), max(sizes)

    def run(batches):
        counters, size = {}, 0
        passes = Sieve(sieve.value) if sieve is not None else None

        def emit():
            for lang, counter in counters.items():
                for grams, n in counter.counts(sizes, passes):
                    for at in range(0, len(grams), BATCH_ROWS):
                        part = grams.slice(at, BATCH_ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, n.slice(at, BATCH_ROWS)], schema=arrow)

        for batch in batches:
            for lang, text in zip(*batch.columns):
                lang, text = lang.as_py(), text.as_py()
                if not text:
                    continue
                if lang not in counters:
                    counters[lang] = Counter(lang, most)
                for words in slices(text):
                    counters[lang].add(words)
                    size += sum(map(len, words)) + len(words)
                    if size >= CHUNK_BYTES:
                        yield from emit()
                        counters, size = {lang: Counter(lang, most, counters[lang].tail())}, 0
        yield from emit()

    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    sent = docs.select(lang, "text").mapInArrow(run, "lang string, gram string, n long")
    return sent.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sieve_of(kept: DataFrame, size: int):
    """A broadcast Bloom filter of the n-grams ``kept`` of ``size`` words: 16 bits for each, at
    most 2**SIEVE_BITS in all. A full one lets more through, and more is counted than need be."""
    n = kept.count()
    bits = 1 << min(max(16, (16 * n).bit_length()), SIEVE_BITS)

    def run(batches):
        for batch in batches:
            values = [window_values(word_values(lang, gram.encode("utf-8", "replace").split(b" ")), size)[0]
                      for lang, gram in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            for place in Sieve.places(np.array(values, np.uint64), bits):
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(15)).astype(np.int64)), pa.array((place & np.uint64(32767)).astype(np.int64))],
                                                 names=["part", "bit"])

    parts = kept.select("lang", "gram").mapInArrow(run, "part long, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    data = bytearray(bits // 8)
    for row in parts.collect():  # bits / 8 bytes at most
        data[row["part"] * 4096:(row["part"] + 1) * 4096] = row["bits"]
    return kept.sparkSession.sparkContext.broadcast(bytes(data))


def frequent_ngrams(docs: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """lang, gram and n of the n-grams of at most ``max_words`` words that occur ``min_count``
    times, and of the empty one.

    Words and pairs are counted at once. Longer ones are counted length by length, and of these
    only those whose two parts of one word less are frequent: the others can't be.
    """
    enough = (F.col("gram") == "") | (F.col("n") >= min_count)
    level = materialise(count_ngrams(docs, (1, 2)[:max_words]).where(enough), "collocation-counts")
    kept, level = level, level.where(F.col("gram").contains(" "))
    for size in range(3, max_words + 1):
        level = materialise(count_ngrams(docs, (size,), sieve_of(level, size - 1)).where(enough), "collocation-counts")
        kept = kept.unionByName(level)
    return kept


class Stream:
    """One pass over a run of n-grams in order, each with its count.

    n-grams that begin alike stand together and the shorter first, so those that the present
    one begins with are the stack: they give it the counts of its beginnings and get from it
    that of their extension. ``begun`` are the beginnings of the run's first n-gram that stand
    in earlier runs.
    """

    def __init__(self, begun: list[tuple[tuple, int]]):
        self.stack = []  # [key, count, counts of its beginnings, largest extension, of this run]
        for key, n in begun:
            self._push(key, n, False)

    def _push(self, key: tuple, n: int, own: bool) -> None:
        above = self.stack[-1] if self.stack else None
        self.stack.append([key, n, [*above[2], above[1]] if above else [], 0, own])

    def read(self, rows) -> Iterator[tuple]:
        """(key, count or None, counts of beginnings, largest count of an extension by a word)"""
        stack = self.stack
        for key, n in rows:
            while stack and key[:len(stack[-1][0])] != stack[-1][0]:
                yield self._done(stack.pop())
            if len(stack) != len(key) - 2:
                raise ValueError(f"counts of beginnings of {key} are missing")
            if stack:
                stack[-1][3] = max(stack[-1][3], n)
            self._push(key, n, True)
        while stack:
            yield self._done(stack.pop())

    @staticmethod
    def _done(entry: list) -> tuple:
        key, n, before, extension, own = entry
        return key, n if own else None, before if own else None, extension


def merged(kept: DataFrame) -> DataFrame:
    """lang, gram, a, pre, post, longer of each n-gram in ``kept`` (lang, gram, n): its count, those
    of its beginnings and of its ends (of one word first), and the largest count of a sequence
    that is one word longer at either side.

    The n-grams are put into prefix order and, their words reversed, into suffix order. Each
    order is cut into runs of bounded size at sampled n-grams. What a run must know of earlier
    ones are the beginnings of its first n-gram, and that is an n-gram of the sample.
    """
    parts = -(-kept.count() // RUN_ROWS)
    sample = []
    if parts > 1:
        sample = [(r["lang"], r["gram"].split(" ")) for r in kept.select("lang", "gram").orderBy(
            F.xxhash64("lang", "gram"), "lang", "gram").limit(parts * SAMPLED).collect()]  # SAMPLED for each run
    cuts, begun = [], []
    for order in (0, 1):
        keys = sorted((lang, *(words[::-1] if order else words)) for lang, words in sample)
        cuts.append(keys[SAMPLED::SAMPLED])
        begun.append({key[:end] for key in cuts[-1] for end in range(2, len(key))})
    needed = {(key[0], " ".join(key[:0:-1] if order else key[1:])) for order in (0, 1) for key in begun[order]}
    counts = {}
    if needed:  # a few for each run
        wanted = kept.sparkSession.createDataFrame(sorted(needed), "lang string, gram string")
        counts = {(r["lang"], r["gram"]): r["n"] for r in kept.join(wanted, ["lang", "gram"]).collect()}

    placed = T.StructType.fromDDL("backwards int, run int, lang string, gram string, n long")
    placed_arrow = to_arrow_schema(placed)

    def place(batches):
        for batch in batches:
            langs, grams = (c.to_pylist() for c in batch.columns[:2])
            keys = [(lang, *gram.split(" ")) for lang, gram in zip(langs, grams)]
            for order in (0, 1):
                ordered = [(k[0], *k[:0:-1]) for k in keys] if order else keys
                runs = [bisect_right(cuts[order], k) for k in ordered]
                yield pa.RecordBatch.from_arrays([pa.array([order] * len(runs), pa.int32()), pa.array(runs, pa.int32()),
                                                  *batch.columns], schema=placed_arrow)

    made = T.StructType.fromDDL("lang string, gram string, a long, pre array<long>, post array<long>, longer long")
    arrow = to_arrow_schema(made)

    def read(table):
        order, run = table["backwards"][0].as_py(), table["run"][0].as_py()
        step = -1 if order else 1
        rows = sorted(((lang, *gram.split(" ")[::step]), n) for lang, gram, n in zip(
            *(table[c].to_pylist() for c in ("lang", "gram", "n"))))
        first = cuts[order][run - 1] if run else ()
        chain = [(first[:end], counts[first[0], " ".join(first[1:end][::step])]) for end in range(2, len(first))]
        out = [[], [], [], [], [], []]
        for key, n, before, extension in Stream(chain).read(rows):
            row = (key[0], " ".join(key[1:][::step]), n, *((None, before) if order else (before, None)), extension)
            for column, value in zip(out, row):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

    streams = kept.select("lang", "gram", "n").mapInArrow(place, placed).groupBy("backwards", "run").applyInArrow(read, made)
    return streams.groupBy("lang", "gram").agg(*[F.max(c).alias(c) for c in ("a", "pre", "post", "longer")])


def scored(phrases: DataFrame) -> DataFrame:
    """``phrases`` (a, pre, post) with the cut of the lowest score: score, l and r."""
    product = "CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div ({product})")
    one = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("pre"))))  # words of the first part
    one = one.withColumn("l", F.get("pre", F.col("k") - 1)).withColumn("r", F.get("post", F.size("post") - F.col("k")))
    one = one.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r"))
    least = one.groupBy("lang", "gram").agg(F.min("cut").alias("cut"), F.first("a").alias("a"), F.first("longer").alias("longer"))
    return least.select("lang", "gram", "a", "longer", "cut.score", "cut.l", "cut.r")


def collocations(docs: DataFrame, max_words=3, min_count=10, inside_percent=50, top=2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language.

    Phrases are sequences of 2 to ``max_words`` words within pieces of the texts that occur
    ``min_count`` times (a). A phrase is cut in two where its score, a million times a² by
    the product of the parts' counts l and r, is lowest, at the first such place; the
    arithmetic is exact. A phrase is left out if a longer one that holds it, and occurs
    ``min_count`` times, has ``inside_percent`` of its occurrences. n: words of the language.

    All texts are counted, once and again for each length from three on; rare n-grams are left
    out after that. A phrase's parts are at least as frequent, so the counts kept hold all that
    it needs. A null language is
    ``und``, null and empty texts have no words, repeated rows count each, other columns are
    not read, an empty table gives an empty one.
    """
    kept = frequent_ngrams(docs.select("lang", "text"), max_words, min_count)
    streams = merged(kept.where("gram <> ''"))
    # the longest phrase inside a longer one is inside one that is a single word longer
    phrases = scored(streams.where("size(pre) > 0")).where(100 * F.coalesce("longer", F.lit(0)) < inside_percent * F.col("a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "gram")
    best = phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    words = kept.where("gram = ''").select("lang", F.col("n"))
    return best.join(words, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
phrases AS (SELECT lang, k AS size, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS cut FROM phrases),
scores AS (
  SELECT c.lang, c.g, c.size, c.a, c.cut, x.f AS l, y.f AS r,
         (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.w[c.cut + 1:], ' ')),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longest AS (
  SELECT lang, g, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS g FROM phrases WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM phrases WHERE size = 3) GROUP BY lang, g),
ranked AS (
  SELECT s.lang, s.g AS phrase, s.a, s.l, s.r, s.score,
         row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.g) AS rank
  FROM lowest s LEFT JOIN longest o USING (lang, g) WHERE 100 * coalesce(o.longer, 0) < 50 * s.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""
