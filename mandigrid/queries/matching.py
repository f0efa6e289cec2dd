"""Misspelt names, addresses and pin codes."""

from pyspark.sql import functions as F

from mandigrid.functions.similarity import fuzzy_match, ngram_similarity
from mandigrid.operators import locate, matching
from mandigrid.queries.common import n, present, s
from mandigrid.sources.standins import documents, table



def _damaged(c):
    """The second letter left out."""
    return F.concat(F.substring(c, 1, 1), F.substring(c, F.lit(3), F.length(c)))


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", "p_name").distinct()


def fuzzy_best(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    left = names.select("p_type", _damaged("p_name").alias("written"))
    return present(matching.best_match(
        matching.candidates(left, names, "written", "p_name", 2, ["p_type"]), ["p_type"]))


def fuzzy_contains(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    right = names.select("p_type", F.element_at(F.split("p_name", " "), 2).alias("word"))
    return present(matching.best_match(
        matching.candidates(names, right, "p_name", "word", 1, ["p_type"], contains=True),
        ["p_type"]))


def fuzzy_alternates(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    left = part.select(
        F.when(F.col("p_type") == "ECONOMY", _damaged("p_name"))
        .otherwise(F.concat_ws(" ", "p_type", "p_name")).alias("name"),
        F.concat_ws("|", F.lit("nowhere & beyond"), _damaged(_damaged("p_name")))
        .alias("alternates"))
    return present(matching.best_match(matching.alternate_candidates(
        left, part, "name", "alternates", "p_name", 1, 2)))


def assign_once(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    left = names.select("p_type", _damaged("p_name").alias("written"))
    pairs = matching.candidates(left, names, "written", "p_name", 3, ["p_type"])
    return present(matching.assign_once(pairs, ["p_type"]))


def similarity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pairs = part.select(F.col("p_name").alias("a"), F.concat_ws(
        " ", F.element_at(F.split("p_name", " "), 2), "p_type", "p_name").alias("b")).distinct()
    return present(pairs.withColumns({"similarity": ngram_similarity("a", "b"),
                                      "fuzzy": fuzzy_match("a", _damaged("a")).cast("int")}))


def _words(spark, sf_dir):
    docs = documents(spark, sf_dir, "lang", "text")
    return docs.select("lang", F.explode(
        F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))


def canonical_spelling(spark, sf_dir):
    """Every word of every text, by language, against the words one edit away."""
    return matching.canonical_spelling(_words(spark, sf_dir), "word", ["lang"], 1)


def pin_best_location(spark, sf_dir):
    """Orders as addresses: their lines' parts are the places that share the pin."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    postal = table(spark, sf_dir, "lineitem").join(
        part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("pin"), F.col("p_name").alias("taluk"),
        F.col("p_brand").alias("district"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderkey").alias("pin"),
        F.concat(F.lit("Brand#2"), "o_orderstatus").alias("district"),
        F.when(F.col("o_orderpriority") != "1-URGENT",
               F.concat(F.lit("blue "), F.lower("o_orderpriority"))).alias("taluk"))
    return present(locate.best_by_pin(orders, postal, "o_orderkey"))


def district_from_taluk(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    taluk = F.concat_ws(" ", "p_name", "p_size", "p_type")
    postal = part.select(taluk.alias("taluk"), F.col("p_brand").alias("district"))
    markets = part.select("p_partkey", taluk.alias("taluk"),
                          F.when(F.col("p_size") > 20, F.lit("known")).alias("district"))
    return locate.district_from_taluk(markets, postal)


# --- SQL -------------------------------------------------------------------

def damaged(x):
    return f"(substr({x}, 1, 1) || substr({x}, 3))"


def sims(pairs, a="a", b="b", tag="sim"):
    """CTEs that end in ``sim(a, b, similarity)`` for the distinct pairs of a CTE."""
    grams = ("unnest(list_transform(range(1, length({0}) + 3),"
             " lambda i: ('$$' || lower({0}) || '$$')[i:i+2]))")
    return f"""
{tag}_pairs AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {pairs}),
{tag}_names AS (SELECT a AS x FROM {tag}_pairs UNION SELECT b FROM {tag}_pairs),
{tag}_grams AS (SELECT x, g, count(*) AS c FROM (SELECT x, {grams.format('x')} AS g
                FROM {tag}_names) GROUP BY x, g),
{tag}_shared AS (
  SELECT p.a, p.b, sum(least(ga.c, gb.c)) AS m FROM {tag}_pairs p
  JOIN {tag}_grams ga ON ga.x = p.a JOIN {tag}_grams gb ON gb.x = p.b AND gb.g = ga.g
  GROUP BY p.a, p.b),
{tag} AS (
  SELECT p.a, p.b, CAST(coalesce(m, 0) AS DOUBLE)
         / (length(p.a) + 2 + length(p.b) + 2 - coalesce(m, 0)) AS similarity
  FROM {tag}_pairs p LEFT JOIN {tag}_shared s ON s.a = p.a AND s.b = p.b)"""


_BEST = f"""SELECT {{block}}a AS left_name, b AS right_name, {n('{pass_}')} AS pass,
       {s('similarity')} AS similarity, {n('levenshtein(lower(a), lower(b))')} AS distance
FROM {{source}} QUALIFY row_number() OVER (PARTITION BY {{block}}a ORDER BY {{pass_}},
  similarity DESC, levenshtein(lower(a), lower(b)), b) = 1"""

_PARTS = "parts AS (SELECT DISTINCT p_type, p_name FROM part)"


def _best_sql(left, right, predicate):
    best = _BEST.replace("{block}", "p_type, ").replace("{pass_}", "1").replace(
        "{source}", "pairs JOIN sim USING (a, b)")
    return f"""WITH {_PARTS},
l AS (SELECT DISTINCT p_type, {left} AS a FROM parts),
r AS (SELECT DISTINCT p_type, {right} AS b FROM parts),
pairs AS (SELECT l.p_type, a, b FROM l JOIN r ON l.p_type = r.p_type WHERE {predicate}),
{sims('pairs')}
{best}"""


# through all pairs from the best on: a pair is taken if both names are still free
_ASSIGN = f"""WITH {_PARTS},
l AS (SELECT DISTINCT p_type, {damaged('p_name')} AS a FROM parts),
r AS (SELECT DISTINCT p_type, p_name AS b FROM parts),
pairs AS (SELECT l.p_type, a, b FROM l JOIN r ON l.p_type = r.p_type
          WHERE levenshtein(lower(a), lower(b)) <= 3),
{sims('pairs')},
scored AS (SELECT p_type, similarity, levenshtein(lower(a), lower(b)) AS distance,
                  {{'a': a, 'b': b}} AS pair,
                  ('0x' || substr(md5(a || chr(1) || b), 1, 15))::BIGINT AS tie
           FROM pairs JOIN sim USING (a, b)),
taken AS (
  SELECT p_type, unnest(list_reduce(list([pair] ORDER BY similarity DESC, distance, tie),
         lambda done, one: CASE WHEN list_contains(list_transform(done, lambda d: d.a), one[1].a)
                                  OR list_contains(list_transform(done, lambda d: d.b), one[1].b)
                                THEN done ELSE list_concat(done, one) END)) AS pair
  FROM scored GROUP BY p_type)
SELECT t.p_type, t.pair.a AS left_name, t.pair.b AS right_name, {n('1')} AS pass,
       {s('similarity')} AS similarity, {n('distance')} AS distance
FROM taken t JOIN scored USING (p_type, pair)"""

_ALTERNATES = f"""WITH {_PARTS},
l AS (SELECT DISTINCT CASE WHEN p_type = 'ECONOMY' THEN {damaged('p_name')}
             ELSE p_type || ' ' || p_name END AS a,
             {damaged(damaged('p_name'))} AS alternate FROM parts),
r AS (SELECT DISTINCT p_name AS b FROM parts),
first_pass AS (SELECT DISTINCT 1 AS pass, a, b FROM l, r
               WHERE levenshtein(lower(a), lower(b)) <= 1),
pairs AS (SELECT * FROM first_pass UNION ALL
          SELECT DISTINCT 2, a, b FROM l, r WHERE levenshtein(lower(alternate), lower(b)) <= 2
          AND a NOT IN (SELECT a FROM first_pass)),
{sims('pairs')}
""" + _BEST.replace("{block}", "").replace("{pass_}", "pass").replace(
    "{source}", "pairs JOIN sim USING (a, b)")

# one edit: a letter less, a letter more, or one letter changed in place
_CANONICAL = r"""
WITH w AS (
  SELECT lang, word, count(*) AS n
  FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)
  GROUP BY lang, word),
less AS (
  SELECT lang, word, p, word[:p - 1] || word[p + 1:] AS rest
  FROM (SELECT lang, word, unnest(range(1, length(word) + 1)) AS p FROM w)),
pairs AS (
  SELECT lang, word, word AS other FROM w UNION
  SELECT l.lang, l.word, w.word FROM less l JOIN w ON w.lang = l.lang AND w.word = l.rest UNION
  SELECT l.lang, w.word, l.word FROM less l JOIN w ON w.lang = l.lang AND w.word = l.rest UNION
  SELECT a.lang, a.word, b.word FROM less a
  JOIN less b ON a.lang = b.lang AND a.p = b.p AND a.rest = b.rest
  WHERE length(a.word) = length(b.word))
SELECT p.lang, p.word, p.other AS canonical
FROM pairs p JOIN w ON w.lang = p.lang AND w.word = p.other
QUALIFY row_number() OVER (PARTITION BY p.lang, p.word ORDER BY w.n DESC, p.other) = 1"""

_PIN = f"""
WITH postal AS (SELECT DISTINCT l_orderkey AS pin, p_name AS taluk, p_brand AS district
                FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT o_orderkey, 'Brand#2' || o_orderstatus AS d,
             CASE WHEN o_orderpriority <> '1-URGENT' THEN 'blue ' || lower(o_orderpriority) END AS t
      FROM orders),
c AS (SELECT o_orderkey, d, t, taluk, district FROM o JOIN postal ON pin = o_orderkey),
cd AS (SELECT d, district FROM c), ct AS (SELECT t, taluk FROM c WHERE t IS NOT NULL),
{sims('cd', 'd', 'district', 'sd')}, {sims('ct', 't', 'taluk', 'st')}
SELECT o_orderkey, district AS pin_district, taluk AS pin_taluk,
       {s('sd.similarity + coalesce(st.similarity, 0)')} AS score
FROM c JOIN sd ON sd.a = d AND sd.b = district LEFT JOIN st ON st.a = t AND st.b = taluk
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY
  sd.similarity + coalesce(st.similarity, 0) DESC, district, taluk) = 1"""

QUERIES = {
    "fuzzy_best": (fuzzy_best, _best_sql(
        damaged("p_name"), "p_name", "levenshtein(lower(a), lower(b)) <= 2")),
    "fuzzy_contains": (fuzzy_contains, _best_sql(
        "p_name", "string_split(p_name, ' ')[2]",
        "contains(a, b) OR contains(b, a) OR levenshtein(lower(a), lower(b)) <= 1")),
    "fuzzy_alternates": (fuzzy_alternates, _ALTERNATES),
    "assign_once": (assign_once, _ASSIGN),
    "ngram_similarity": (similarity, f"""
WITH pairs AS (SELECT DISTINCT p_name AS a, string_split(p_name, ' ')[2] || ' ' || p_type || ' '
               || p_name AS b FROM part),
{sims('pairs')}
SELECT a, b, {s('similarity')} AS similarity,
       {n(f"levenshtein(lower(a), lower({damaged('a')})) <= 2")} AS fuzzy FROM sim"""),
    "canonical_spelling": (canonical_spelling, _CANONICAL),
    "pin_best_location": (pin_best_location, _PIN),
    "district_from_taluk": (district_from_taluk, """
WITH r AS (SELECT p_partkey, p_size, p_brand, concat_ws(' ', p_name, p_size, p_type) AS taluk
           FROM part),
u AS (SELECT taluk, min(p_brand) AS only_district FROM r GROUP BY taluk
      HAVING count(DISTINCT p_brand) = 1)
SELECT p_partkey, r.taluk, CASE WHEN p_size > 20 THEN 'known' ELSE only_district END AS district
FROM r LEFT JOIN u ON r.taluk = u.taluk"""),
}
