"""How alike two names are, as Column expressions."""

from pyspark.sql import Column, functions as F

from mandigrid.functions.missing import col

_N = 3
_PAD = "$"


def let(value, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often it is used.

    A lambda would otherwise recompute what it refers to for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def grams(c) -> Column:
    """All trigrams of the padded text, repeats included."""
    pad = F.lit(_PAD * (_N - 1))
    padded = F.concat(pad, col(c), pad)
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{_N}}}))"), F.lit(1))


def _count_shared(a: Column, b: Column) -> Column:
    def times(xs, gram):
        return F.size(F.filter(xs, lambda x: x == gram))

    return F.aggregate(
        F.array_distinct(a), F.lit(0),
        lambda total, gram: total + F.least(times(a, gram), times(b, gram)),
    )


def _overlap(a: Column, b: Column) -> Column:
    """Shared over all. Repeats have to be counted only if both texts have some."""
    def no_repeats(xs):
        return F.size(F.array_distinct(xs)) == F.size(xs)

    shared = F.when(no_repeats(a) | no_repeats(b), F.size(F.array_intersect(a, b))).otherwise(
        _count_shared(a, b))
    return let(shared, lambda m: m / (F.size(a) + F.size(b) - m))


def ngram_similarity(a, b) -> Column:
    """Shared trigrams over all trigrams, in [0, 1]; case does not count."""
    both = F.struct(grams(F.lower(col(a))).alias("a"), grams(F.lower(col(b))).alias("b"))
    return let(both, lambda x: _overlap(x["a"], x["b"]))


def within(a, b, k) -> Column:
    """True if at most ``k`` edits (a number or a Column) turn a into b."""
    if isinstance(k, int):
        return F.levenshtein(col(a), col(b), k) >= 0
    return F.levenshtein(col(a), col(b)) <= k


def edit_allowance(name, default: int = 2) -> Column:
    """Edits allowed for a name: compass words are strict, upper/lower fixed at 2."""
    low = F.lower(col(name))
    return (F.when(low.rlike("upper|lower"), 2)
            .when(low.rlike("west|east"), 1)
            .otherwise(default))


def fuzzy_match(name, other, default: int = 2) -> Column:
    name, other = col(name), col(other)
    return F.levenshtein(F.lower(name), F.lower(other)) <= edit_allowance(name, default)
