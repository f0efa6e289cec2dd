"""Quality rules: fixed limits, then boosted trees over document statistics."""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import per_row, texts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: What the trees see, with the direction that a feature may move the badness in: more
#: symbols, repeats or shouting never make a text better (+1); 0 is free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": 1, "dup_lines": 1, "repeats": 1, "capitals": 1, "digits": 0,
    "marks": 0, "distinct_words": 0, "line_words": 0, "longest_word": 0, "symbol_words": 1, "sentence_ends": 0,
    "top_word": 1, "shout_words": 1, "loud_ends": 1,
}
# Labelled rows that the trees are fitted on, at most.
SAMPLE_ROWS = 20_000

_CLASS = np.zeros(256, np.uint8)  # of a byte: 1 capital, 2 digit, 3 other mark; 0 the rest
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_STARTS = bytes(b for b in range(256) if not 128 <= b < 192)  # bytes that begin a character


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    marked = np.zeros(len(words), bool)
    at = np.flatnonzero(np.fromiter((seen[w] > 1 for w in windows), bool, len(windows)))
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of BASE and the values of FEATURES of one whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, joined = len(words), b"".join(words)
    chars = len(joined) - len(joined.translate(None, _STARTS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup, repeats = len(lines) - len(set(lines)), repeated_words(words)
    base = [n, chars, symbols, dup, repeats]
    if not n:
        return base, [0.0] * len(FEATURES)
    _, capitals, digits, marks = np.bincount(_CLASS[np.frombuffer(joined, np.uint8)], minlength=4)[:4] / len(joined)
    seen = Counter(words)
    return base, [
        float(np.log1p(n)), chars / n, symbols / n, dup / len(lines), repeats / n, float(capitals), float(digits),
        float(marks), len(seen) / n, n / len(lines), float(np.log1p(max(map(len, words)))),
        sum(c for w, c in seen.items() if w[-1] in SYMBOLS) / n, sum(c for w, c in seen.items() if w[-1] == 46) / n,
        max(seen.values()) / n, sum(c for w, c in seen.items() if w.isupper()) / n,
        sum(c for w, c in seen.items() if w[-1] == 33) / n,
    ]


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the counts of BASE and the array ``features``."""
    def make():
        def function(batch):
            rows = [statistics(t) for t in texts(batch.column(0))]
            counts = np.array([b for b, _ in rows], np.int64).reshape(-1, len(BASE))
            return [*(pa.array(counts[:, i]) for i in range(len(BASE))), pa.array([f for _, f in rows], pa.list_(pa.float64()))]

        return function

    return per_row(docs, ["text"], ", ".join(f"{c} long" for c in BASE) + ", features array<double>", make, keep)


@dataclass
class Trees:
    """Nodes of all trees in flat arrays: a leaf points at itself, so that every row takes the
    same number of steps."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # left child; the right one follows it
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                split = self.feature[node] >= 0
                right = x[rows, np.maximum(self.feature[node], 0)] > self.threshold[node]
                node = np.where(split, self.child[node] + right, node)
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone, rounds=80, depth=4, rate=0.15, bins=64, least=10, ridge=1.0) -> Trees:
    """Newton boosting of the logistic loss on binned features.

    A split on a monotone feature needs children in order, and their subtrees are held to
    their side of the middle, so that no later split can break the order.
    """
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins)[1:-1])) for column in x.T]
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # > edge k: code > k
    width = max(len(e) for e in edges) + 1
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    score, feature, threshold, child, value, roots = np.full(len(y), start), [], [], [], [], []
    flat = code + np.arange(x.shape[1]) * width
    order = np.array(monotone)

    def node() -> int:
        feature.append(-1)
        threshold.append(0.0)
        child.append(len(child))
        value.append(0.0)
        return len(feature) - 1

    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        grad, hess = prob - y, prob * (1 - prob)
        roots.append(node())
        work = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while work:
            at, rows, level, low, high = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[at] = rate * float(np.clip(-g / (h + ridge), low, high))
            best = None
            if level < depth and len(rows) >= 2 * least:
                cells = flat[rows].ravel()
                size = width * x.shape[1]
                sums = [np.bincount(cells, np.repeat(v, x.shape[1]) if v is not None else None, size).reshape(-1, width).cumsum(1)
                        for v in (grad[rows], hess[rows], None)]
                gl, hl, nl = sums
                gr, hr, nr = g - gl, h - hl, len(rows) - nl
                left, right = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                loss = lambda s, t, v: -(2 * s * v + (t + ridge) * v * v)
                own = np.clip(-g / (h + ridge), low, high)
                gain = loss(gl, hl, left) + loss(gr, hr, right) - loss(g, h, own)
                bad = (nl < least) | (nr < least) | ((right - left) * order[:, None] < 0)
                gain = np.where(bad, -np.inf, gain)
                k = int(gain.argmax())
                if gain.flat[k] > 1e-6:
                    best = divmod(k, width)
            if best is None:
                score[rows] += value[at]
                continue
            f, b = best
            feature[at], threshold[at] = f, float(edges[f][b])
            child[at] = node()
            node()
            inside = code[rows, f] <= b
            middle = (left[f, b] + right[f, b]) / 2
            bounds = [(low, high), (low, high)]
            if order[f]:
                below, above = (low, middle), (middle, high)
                bounds = [below, above] if order[f] > 0 else [above, below]
            for side, (part, (lo, hi)) in enumerate(zip((rows[inside], rows[~inside]), bounds)):
                work.append((child[at] + side, part, level + 1, lo, hi))
    return Trees(np.array(feature), np.array(threshold), np.array(child), np.array(value), np.array(roots), depth, start)


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and ``label`` of at most ``rows`` labelled documents, first by a hash of the id.

    Labels that are null or stand for an id in several values are left out. The sample is
    bounded, and so may be broadcast against the documents.
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id")
           .agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other"))
    sample = one.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample_rows=SAMPLE_ROWS) -> Trees | None:
    """Trees for the badness of a document (label quality 0), learned from at most
    ``sample_rows`` labelled ids, of which only the statistics reach the driver (again bounded,
    where ids repeat in ``docs``). None unless both labels occur."""
    sample = described(labelled(docs, labels, "quality", sample_rows), ["label"])
    rows = sample.select("label", "features").limit(2 * sample_rows).toArrow()
    y = (rows["label"].to_numpy() == 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(rows["features"].to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same trees in whichever order the rows came
    return fit_trees(x[order], y[order], list(FEATURES.values()))


def apply_rules(docs: DataFrame, trees: Trees | None, keep=None, cut=0.5) -> DataFrame:
    """``docs`` with the counts of BASE, ``base_failed``, ``badness`` and ``kept``.

    Base rules: at least 50 words, and no more than half of the words in repeated windows.
    Then the trees' badness must stay below ``cut`` (without trees it is 0). One pass over the
    whole texts, without a shuffle. Null and empty texts have no words and fail; repeated rows
    are judged alike; an empty table stays empty.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*BASE, "base_failed", "badness", "kept")]

    def make():
        def function(batch):
            rows = [statistics(t) for t in texts(batch.column(0))]
            counts = np.array([b for b, _ in rows], np.int64).reshape(-1, len(BASE))
            x = np.array([f for _, f in rows], float).reshape(-1, len(FEATURES))
            bad = trees.probability(x) if trees and len(x) else np.zeros(len(x))
            return [*(pa.array(counts[:, i]) for i in range(len(BASE))), pa.array(bad)]

        return function

    out = per_row(docs, ["text"], ", ".join(f"{c} long" for c in BASE) + ", badness double", make, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *BASE, failed.alias("base_failed"), "badness",
                      (~failed & (F.col("badness") < cut)).alias("kept"))
