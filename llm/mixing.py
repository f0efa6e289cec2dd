"""Mixing sources to target weights by hash thresholds: no document is ever sorted."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import WORD
from mandigrid.session import materialise

# Bits of a document's hash (15 hexadecimal digits of an MD5) and bits read by each histogram.
HASH_BITS, STEP_BITS = 60, 15
# A table of thresholds, one row a source, is broadcast up to this many rows, and joined by
# shuffle beyond.
BROADCAST_SOURCES = 20_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id, text):
    """60 bits that depend on the document alone, so that reruns agree and larger budgets
    contain smaller ones. Rows with equal id and text stand or fall together."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source):
    """Null apart from every name."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def targets(sized: DataFrame, weights=(3, 1, 2), share=(3, 2), most=2) -> DataFrame:
    """key, source_size and target of each source of ``sized`` (key, size).

    ``weights`` go to the sources by code point, null last, in turn. They share ``share``
    (numerator, denominator) of all sizes. A target stops at ``most`` times its source's
    size and what is above goes to the others by weight, until none is above: the sources
    are filled in the order of size by weight. The numbers are whole until one division.
    """
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("key") == "", "key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long")
    # one row a source from here on
    weighed = totals.withColumn("weight", weight)
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("source_size") / F.col("weight"), F.col("key") == "", "key").rowsBetween(Window.unboundedPreceding, -1)
    up, down = share
    budget = up * F.sum("source_size").over(every)  # times down
    left = budget - down * most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = down * most * F.col("source_size") * rest <= F.col("weight") * left
    flagged = weighed.withColumn("full", full).withColumn("budget", budget)
    kept = lambda c: F.sum(F.when(F.col("full"), 0).otherwise(F.col(c))).over(every)
    open_budget = F.col("budget") - down * most * (F.sum("source_size").over(every) - kept("source_size"))
    target = (F.when(F.col("full"), (most * F.col("source_size")).cast("double"))
              .otherwise(F.col("weight") * open_budget / (down * kept("weight"))))
    return flagged.select("key", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame, beside=F.broadcast) -> DataFrame:
    """``wanted`` (targets) with ``whole`` passes and the hash ``below`` which documents get
    one pass more (null: all of them). ``beside`` says how a row a source is joined.

    One histogram of sizes by source and the leading bits of the hash finds the bucket in
    which the budget runs out; each further one looks into this bucket alone. What is left in
    the end is one hash value, taken if that comes nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    passes = wanted.withColumn("whole", whole)
    at = passes.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
                       F.lit(0).cast("long").alias("bucket"))
    for low in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = sized.withColumn("bucket", F.shiftright("hash", low + STEP_BITS)).join(beside(at.drop("size")), ["key", "bucket"])
        cells = inside.groupBy("key", "left", F.shiftright("hash", low).alias("cell")).agg(F.sum("size").alias("size"))
        so_far = F.sum("size").over(Window.partitionBy("key").orderBy("cell"))
        first = F.min(F.struct("cell", (F.col("left") - F.col("so_far") + F.col("size")).alias("left"), "size"))
        found = cells.withColumn("so_far", so_far).where("so_far > left").groupBy("key").agg(first.alias("f"))
        at = found.select("key", "f.left", F.col("f.cell").alias("bucket"), "f.size")
    last = at.select("key", F.when(2 * F.col("left") >= F.col("size"), F.col("bucket") + 1)
                     .otherwise(F.col("bucket")).alias("below"))
    return passes.join(last, "key", "left")


def mix(docs: DataFrame, keep=None, weights=(3, 1, 2), share=(3, 2), most=2) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` and ``taken``.

    ``taken`` is the size times the passes over the document: 0 to ``most``. The words taken
    of a source miss its target by half the document at the threshold at most. Null texts
    have size 0; a null source is a source; an empty table gives an empty one. Columns of
    ``docs`` with a new column's name are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "taken")]
    column = lambda c: docs[f"`{c}`"]
    own = {"__key": source_key(column("source")), "__size": word_count(column("text")),
           "__hash": document_hash(column("doc_id"), column("text"))}
    names = [F.col(x).alias(x.strip("_")) for x in own]
    sized = materialise(docs.select(*[v.alias(k) for k, v in own.items()]).select(*names), "mix-sizes")
    wanted = materialise(targets(sized, weights, share, most), "mix-targets")
    beside = F.broadcast if wanted.count() <= BROADCAST_SOURCES else lambda df: df
    cuts = materialise(thresholds(sized, wanted, beside), "mix-thresholds")
    cuts = beside(cuts.select(*[F.col(c).alias(f"__{c}") for c in cuts.columns]))
    rows = docs.select(*[column(c) for c in keep], *[v.alias(k) for k, v in own.items()]).join(cuts, "__key")
    extra = F.coalesce(F.col("__hash") < F.col("__below"), F.lit(True)) & (F.col("__whole") < most)
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.col("__size").alias("size"),
                       F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                       (F.col("__size") * (F.col("__whole") + extra.cast("long"))).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, '') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (
  SELECT key, sum(size)::BIGINT AS s,
         CASE (row_number() OVER (ORDER BY key = '', key) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sized GROUP BY key),
filled AS (
  SELECT *, sum(s) OVER () AS all_s, sum(w) OVER () AS all_w,
         coalesce(sum(s) OVER f, 0) AS s_before, coalesce(sum(w) OVER f, 0) AS w_before
  FROM totals
  WINDOW f AS (ORDER BY s / w, key = '', key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, 4 * s * (all_w - w_before) <= w * (3 * all_s - 4 * s_before) AS stopped FROM filled),
targets AS (
  SELECT key, s, CASE WHEN stopped THEN (2 * s)::DOUBLE
                 ELSE (w * (3 * all_s - 4 * sum(CASE WHEN stopped THEN s ELSE 0 END) OVER ()))::BIGINT
                      / (2 * sum(CASE WHEN stopped THEN 0 ELSE w END) OVER ())::BIGINT END AS target
  FROM flagged),
budgets AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM targets),
atoms AS (SELECT key, h, sum(size)::BIGINT AS size FROM sized GROUP BY key, h),
placed AS (
  SELECT a.key, a.h, a.size, b.target - b.whole * b.s AS budget,
         sum(a.size) OVER (PARTITION BY a.key ORDER BY a.h) - a.size AS before
  FROM atoms a JOIN budgets b USING (key)),
passes AS (
  SELECT key, h, (before + size <= budget OR (before <= budget AND 2 * (budget - before) >= size))::BIGINT AS extra
  FROM placed)
SELECT doc_id, d.size, b.s AS source_size, b.target,
       (d.size * (b.whole + CASE WHEN b.whole < 2 THEN p.extra ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN budgets b USING (key) JOIN passes p ON p.key = d.key AND p.h = d.h
"""
