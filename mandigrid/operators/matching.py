"""Fuzzy matching of names.

Candidates come from equality joins only and are then checked exactly, so the
result is that of comparing all pairs while the work follows the number of near
matches.

Up to three edits: names within k edits have a common remainder after at most k
letters are struck from each. Names that share one are at most 2k edits apart, so
even among names that are mostly alike few wrong candidates arise.

More edits would leave too many remainders. There a name is cut into k + 1
segments, one of which must occur in the other name near its place.
"""

from pyspark.sql import DataFrame, functions as F

from mandigrid.functions.missing import col
from mandigrid.functions.similarity import ngram_similarity
from mandigrid.session import materialise, shared_dir


_MAX_STRUCK = 3


def remainders(name, k: int):
    """Everything that is left of a name after at most k letters are struck."""
    def without_one(x):
        return F.when(F.length(x) > 0, F.transform(
            F.sequence(F.lit(1), F.length(x)),
            lambda p: F.concat(F.substring(x, F.lit(1), p - 1),
                               F.substring(x, p + 1, F.length(x))),
        )).otherwise(F.array().cast("array<string>"))

    out = F.array(col(name))
    for _ in range(k):
        out = F.array_distinct(F.flatten(F.transform(
            out, lambda x: F.concat(F.array(x), without_one(x)))))
    return out


def _segment_start(length, i, k):
    """Segments are as even as possible, the longer ones at the end."""
    short = F.floor(length / (k + 1))
    longer = length - short * (k + 1)
    return i * short + F.greatest(F.lit(0), i - (k + 1 - longer))


def _segment_length(length, i, k):
    return _segment_start(length, i + 1, k) - _segment_start(length, i, k)


def _piece(length, i, name, start, size):
    return F.struct(length.cast("int").alias("len"), i.cast("int").alias("seg"),
                    F.substring(name, (start + 1).cast("int"), size.cast("int")).alias("text"))


def segments(name, k: int):
    """The k + 1 segments of a name, tagged with its length and their number."""
    name = col(name)
    n = F.length(name)
    return F.transform(
        F.sequence(F.lit(0), F.lit(k)),
        lambda i: _piece(n, i, name, _segment_start(n, i, k), _segment_length(n, i, k)))


def probes(name, k: int):
    """Every piece of a name that can be a segment of a name within k edits."""
    name = col(name)
    n = F.length(name)

    def for_segment(length, i):
        start, size = _segment_start(length, i, k), _segment_length(length, i, k)
        grown = n - length
        low = F.greatest(F.lit(0), start - F.floor((k - grown) / 2))
        high = F.least(n - size, start + F.floor((k + grown) / 2))
        places = F.when(low <= high, F.sequence(low, high)).otherwise(
            F.array().cast("array<bigint>"))
        return F.transform(places, lambda p: _piece(length, i, name, p, size))

    lengths = F.sequence(F.greatest(F.lit(0), n - k), n + k)
    return F.array_distinct(F.flatten(F.transform(
        lengths, lambda length: F.flatten(F.transform(
            F.sequence(F.lit(0), F.lit(k)), lambda i: for_segment(length, i))))))


def near_pairs(left: DataFrame, right: DataFrame, on_left, on_right, k, block=(),
               fold=True) -> DataFrame:
    """Pairs (left name, right name, distance) with at most k edits.

    With ``fold`` case does not count.

    Each side is reduced to its distinct names per block first. The result has
    the block columns, ``left_name``, ``right_name`` and ``distance``.
    """
    block = list(block)
    a = left.select(*block, col(on_left).alias("left_name")).dropna().distinct()
    b = right.select(*block, col(on_right).alias("right_name")).dropna().distinct()
    x, y = F.col("left_name"), F.col("right_name")
    if fold:
        x, y = F.lower(x), F.lower(y)
    if k <= _MAX_STRUCK:
        left_keys, right_keys = remainders(x, k), remainders(y, k)
    else:
        left_keys, right_keys = probes(x, k), segments(y, k)
    # hashed keys keep the shuffle narrow; a collision is one more pair to check
    a = a.select(*block, "left_name", F.explode(left_keys).alias("p"))
    b = b.select(*block, "right_name", F.explode(right_keys).alias("p"))
    a, b = (side.withColumn("p", F.xxhash64("p")) for side in (a, b))
    distance = F.levenshtein(x, y, k)
    # a stored side's size is known before its names are taken apart: joined by shuffle, as the
    # keys are many times larger than that and would all pass the driver in a broadcast
    return (a.join(b.hint("merge"), [*block, "p"]).withColumn("distance", distance)
            .filter("distance >= 0").drop("p").distinct())


def _pieces_of(name):
    """All distinct substrings of a name."""
    n = F.length(name)
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda start: F.transform(
            F.sequence(F.lit(1), n - start + 1),
            lambda size: F.substring(name, start.cast("int"), size.cast("int"))))))


def containing_pairs(left: DataFrame, right: DataFrame, on_left, on_right, block=()) -> DataFrame:
    """Pairs of names of which one contains the other (case counts).

    One side is taken apart into its substrings and joined by equality, once in
    each direction. Meant for names: a name of n letters has n²/2 substrings.
    """
    block = list(block)
    a = left.select(*block, col(on_left).alias("left_name")).dropna().distinct()
    b = right.select(*block, col(on_right).alias("right_name")).dropna().distinct()
    inner_right = (a.select(*block, "left_name", F.explode(_pieces_of(F.col("left_name")))
                            .alias("right_name")).join(b, [*block, "right_name"]))
    inner_left = (b.select(*block, "right_name", F.explode(_pieces_of(F.col("right_name")))
                           .alias("left_name")).join(a, [*block, "left_name"]))
    columns = [*block, "left_name", "right_name"]
    return inner_right.select(*columns).unionByName(inner_left.select(*columns)).distinct()


def candidates(left, right, on_left, on_right, k, block=(), contains=False,
               fold=True) -> DataFrame:
    """Near (and, if asked, containing) pairs with ``similarity`` and ``distance``."""
    pairs = near_pairs(left, right, on_left, on_right, k, block, fold).drop("distance")
    if contains:
        pairs = pairs.unionByName(
            containing_pairs(left, right, on_left, on_right, block)).distinct()
    a, b = F.col("left_name"), F.col("right_name")
    if fold:
        a, b = F.lower(a), F.lower(b)
    return pairs.withColumns({
        "similarity": ngram_similarity("left_name", "right_name"),
        "distance": F.levenshtein(a, b),
    })


def _rank(name, tie=()):
    """Orders candidates: first pass, most similar, fewest edits, then ``tie``, first by name."""
    return F.struct(F.col("pass"), (-F.col("similarity")).alias("s"), F.col("distance"),
                    *tie, F.col(name))


def pair_number(left="left_name", right="right_name"):
    """A number that depends on both names alike, whichever side asks."""
    digits = F.substring(F.md5(F.concat_ws("\u0001", left, right)), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def best_match(pairs: DataFrame, block=(), side="left_name", other="right_name", tie=()) -> DataFrame:
    """The best candidate of every name on one side (an aggregate, not a window)."""
    if "pass" not in pairs.columns:
        pairs = pairs.withColumn("pass", F.lit(1))
    return pairs.groupBy(*block, side).agg(F.min(_rank(other, tie)).alias("_r")).select(
        *block, side, F.col(f"_r.{other}").alias(other), F.col("_r.pass").alias("pass"),
        (-F.col("_r.s")).alias("similarity"), F.col("_r.distance").alias("distance"))


def assign_once(pairs: DataFrame, block=()) -> DataFrame:
    """A matching in which every name of either side is used at most once.

    Pairs that are each other's best are taken, their names leave, and so on
    until no candidate is left. Equally good pairs stand in the order of a number of
    the pair: as both sides agree on it, the order is total, the outcome is that of
    going through all pairs from the best on, and a share of the rivals leaves in every
    round even if all are equal, so that rounds grow with the logarithm of their number.
    Every round is a written table, so a lost executor costs one round at most.
    """
    spark = pairs.sparkSession
    block = list(block)
    if "pass" not in pairs.columns:
        pairs = pairs.withColumn("pass", F.lit(1))
    base = shared_dir(spark, "assign")
    pairs.withColumn("_tie", pair_number()).write.parquet(f"{base}/open-0")
    i = 0
    while True:
        open_pairs = spark.read.parquet(f"{base}/open-{i}")
        if open_pairs.isEmpty():
            break
        # NULL block values do not occur: candidates come from equality joins
        both = best_match(open_pairs, block, tie=["_tie"]).join(
            best_match(open_pairs, block, "right_name", "left_name", ["_tie"])
            .select(*block, "left_name", "right_name"),
            [*block, "left_name", "right_name"])
        both.write.parquet(f"{base}/taken-{i}")
        round_taken = spark.read.parquet(f"{base}/taken-{i}")
        left = (open_pairs
                .join(round_taken.select(*block, "left_name"), [*block, "left_name"], "left_anti")
                .join(round_taken.select(*block, "right_name"), [*block, "right_name"],
                      "left_anti"))
        i += 1
        left.write.parquet(f"{base}/open-{i}")
    if not i:
        return best_match(pairs, block)
    return spark.read.parquet(*[f"{base}/taken-{k}" for k in range(i)])


def with_alternates(left: DataFrame, name, alternates, separator=r"\|") -> DataFrame:
    """(name, spelling, pass): the main name is pass 1, each alternate pass 2."""
    main = left.select("*", F.col(name).alias("spelling"), F.lit(1).alias("pass"))
    alternate = F.explode(F.split(F.replace(F.col(alternates), F.lit("&"), F.lit("and")),
                                  separator))
    other = left.select("*", alternate.alias("spelling"), F.lit(2).alias("pass"))
    return main.unionByName(other).filter(F.length("spelling") > 0)


def alternate_candidates(left, right, name, alternates, on_right, k_main, k_alternate,
                         block=(), contains=False) -> DataFrame:
    """Candidates by main name, else by alternates, scored against the main name."""
    block = list(block)
    spelled = with_alternates(left, name, alternates).select(*block, name, "spelling", "pass")
    main = candidates(spelled.filter("pass = 1"), right, "spelling", on_right, k_main, block,
                      contains)
    other = near_pairs(spelled.filter("pass = 2"), right, "spelling", on_right, k_alternate, block)

    def scored(pairs, n):
        names = spelled.filter(F.col("pass") == n).select(*block, name, "spelling", "pass")
        return pairs.select(*block, F.col("left_name").alias("spelling"), "right_name").join(
            names, [*block, "spelling"]).select(
            *block, F.col(name).alias("left_name"), "right_name", "pass",
            ngram_similarity(name, "right_name").alias("similarity"),
            F.levenshtein(F.lower(name), F.lower("right_name")).alias("distance")).distinct()

    first = scored(main, 1)
    second = scored(other, 2).join(first.select(*block, "left_name").distinct(),
                                   [*block, "left_name"], "left_anti")
    return first.unionByName(second)


def canonical_spelling(df: DataFrame, name, block, k=2) -> DataFrame:
    """Each spelling and the most frequent one within k edits in the same block.

    Ties go to the first name in order.
    """
    block = list(block)
    # the names are far fewer than the rows, and are read three times below
    counts = materialise(df.filter(F.col(name).isNotNull()).groupBy(*block, name).agg(
        F.count(F.lit(1)).alias("n")), "spellings")
    pairs = near_pairs(counts, counts, name, name, k, block, fold=False)
    voted = pairs.join(counts.withColumnRenamed(name, "right_name").hint("merge"), [*block, "right_name"])
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("right_name"))).alias("_r")
    return voted.groupBy(*block, F.col("left_name").alias(name)).agg(best).select(
        *block, name, F.col("_r.right_name").alias("canonical"))


def canonicalise(df: DataFrame, name, block, k=2) -> DataFrame:
    """``df`` with each spelling replaced by the winning one."""
    table = canonical_spelling(df, name, block, k)
    joined = df.join(table, [*block, name], "left")
    return joined.select(*[
        F.coalesce("canonical", name).alias(name) if c == name else F.col(c) for c in df.columns])


def top_candidate(pairs: DataFrame, key, score, name) -> DataFrame:
    """Highest score per key, ties by name."""
    key = [key] if isinstance(key, str) else list(key)
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(name))).alias("_r")
    return pairs.groupBy(*key).agg(best).select(
        *key, F.col(f"_r.{name}").alias(name), (-F.col("_r.s")).alias(score))
