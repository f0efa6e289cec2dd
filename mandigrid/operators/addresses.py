"""Districts and taluks that addresses name, found through an index of the names.

No address is compared with all names of its state. A name that occurs in a text
begins there with an anchor, its longest beginning of 1, 2, 4, 8 or 16 letters, so
texts are taken apart into pieces of these sizes and joined with the anchors by
equality. Names within reach of a phrase share what is left of both after letters
are struck (``near_pairs``). What an address is joined with are the few names that
it can mean; each rule that finds one is a candidate row, and one aggregate takes
the best.
"""

from pyspark.sql import DataFrame, functions as F

from mandigrid.fixed_values import (
    DISTRICT_MARKERS, DISTRICT_REACH, MANDI_LOOKALIKES, MARKET_TALUK_ALIASES,
    NOT_A_DISTRICT_WORD, TALUK_FALSE_SUFFIXES, TALUK_MARKERS, TALUK_REACH, TALUK_STOPWORDS,
)
from mandigrid.functions.missing import col
from mandigrid.functions.similarity import edit_allowance, ngram_similarity
from mandigrid.functions.text import replace_whole, to_initials, words_around
from mandigrid.operators.matching import near_pairs
from mandigrid.session import materialise

DISTRICT_WINDOW = words_around(DISTRICT_MARKERS, DISTRICT_REACH)
TALUK_WINDOW = words_around(TALUK_MARKERS, TALUK_REACH)
_SIZES = (1, 2, 4, 8, 16)
_MOST_EDITS = 2


def _pieces(text):
    """All distinct pieces of a text that can be anchors."""
    found = [F.regexp_extract_all(col(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
             for n in _SIZES]
    return F.array_distinct(F.concat(*found))


def _anchor(name):
    size = F.lit(_SIZES[0])
    for n in _SIZES[1:]:
        size = F.when(F.length(name) >= n, n).otherwise(size)
    return F.substring(col(name), F.lit(1), size)


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of ``names`` (scope, spelling, …) joined with each text (scope, text) that holds
    their spelling; the empty spelling is in none."""
    at = texts.select("scope", "text").distinct().withColumn(
        "_a", F.explode(F.transform(_pieces("text"), lambda p: F.xxhash64(p))))
    index = names.filter(F.length("spelling") > 0).withColumn("_a", F.xxhash64(_anchor("spelling")))
    return at.join(index, ["scope", "_a"]).filter(F.contains("text", F.col("spelling"))).drop("_a")


def near_names(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """Names (scope, name) within two edits of phrases (scope, phrase), with the distance and
    how alike they are; case does not count."""
    pairs = near_pairs(phrases, names, "phrase", "name", _MOST_EDITS, ["scope"])
    return pairs.select("scope", F.col("left_name").alias("phrase"), F.col("right_name").alias(
        "name"), "distance", ngram_similarity("left_name", "right_name").alias("similarity"))


def _windows(address, pattern):
    """Words before and after the first marker; NULL without one."""
    words = [F.trim(F.regexp_extract(address, pattern, i)) for i in (1, 2)]
    return F.when(F.col(address).rlike(pattern), F.array(*words))


def _phrases(rule, phrases):
    """Phrases an address is searched by, with their rule and their place in the address."""
    return F.transform(F.coalesce(phrases, F.array().cast("array<string>")), lambda p, i: F.struct(
        F.lit(rule).alias("rule"), i.alias("place"), p.alias("phrase")))


def _best(candidates):
    """The candidate of the first rule, of those the best, of those the first by name."""
    return F.min(F.struct("rule", "score", "name")).alias("best")


def find_districts(texts: DataFrame, districts: DataFrame) -> DataFrame:
    """(state, address, district, rule, told) of each distinct text (state, address).

    ``districts`` has state and district. The first rule that finds one decides:

    1. a name occurs in the address (the longest); 2. the words around "dist" or "dt"
    are nearly a name; 3. a name's initials occur; 4. a word of the last part is one
    edit from a name. ``told``: the words that rule 2 found a name by, those after the
    marker before those in front of it; NULL if rule 1 decides.
    """
    texts = materialise(texts.filter(F.length("address") > 0).select(
        "state", "address").distinct(), "address-texts")
    names = districts.filter(F.length("district") > 0).select(
        F.col("state").alias("scope"), F.col("district").alias("name")).distinct()
    spelt = names.select("scope", "name", F.lit(1).alias("rule"), F.col("name").alias("spelling"))
    spelt = spelt.unionByName(names.select("scope", "name", F.lit(3).alias("rule"), F.explode(
        to_initials("name")).alias("spelling")))
    scoped = texts.select(F.col("state").alias("scope"), F.col("address").alias("text"))
    held = occurrences(scoped, spelt).select(
        "scope", F.col("text").alias("address"), "rule", "name", F.when(
            F.col("rule") == 1, -F.length("name")).otherwise(0).cast("double").alias("score"),
        F.lit(None).cast("struct<place:int,phrase:string>").alias("told"))

    last_part = F.split(F.element_at(F.split("address", ", "), -1), " ")
    words = F.filter(last_part, lambda w: ~w.isin(*NOT_A_DISTRICT_WORD))
    said = texts.select(F.col("state").alias("scope"), "address", F.inline(F.concat(
        _phrases(2, _windows("address", DISTRICT_WINDOW)), _phrases(4, words))))
    near = near_names(said, names)
    meant = said.join(near, ["scope", "phrase"]).filter(F.col("distance") <= edit_allowance(
        "phrase", F.when(F.col("rule") == 2, 2).otherwise(1)))
    lookalike = (F.col("rule") == 4) & (F.col("phrase") == "Mandi") & F.col("name").isin(
        *MANDI_LOOKALIKES)
    meant = meant.filter(~lookalike).select(
        "scope", "address", "rule", "name", (-F.col("similarity")).alias("score"), F.when(
            (F.col("rule") == 2) & (F.col("phrase") != ""), F.struct("place", "phrase"))
        .alias("told"))
    best = held.unionByName(meant).groupBy("scope", "address").agg(
        _best("name"), F.max("told").alias("told"))
    return best.select(
        F.col("scope").alias("state"), "address", F.col("best.name").alias("district"),
        F.col("best.rule").alias("rule"),
        F.when(F.col("best.rule") > 1, F.col("told.phrase")).alias("told"))


def without_words(address, words):
    """An address less the words its district was told by, if they occur once."""
    address, words = col(address), col(words)
    once = F.size(F.split(address, F.concat(F.lit(r"\Q"), words, F.lit(r"\E")))) == 2
    rest = F.regexp_replace(F.replace(address, words, F.lit("")), r"\s+$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r",+$", ""), r"\s+", " ")
    return F.when((F.length(words) > 0) & once, rest).otherwise(address)


def _taluk_index(postal: DataFrame):
    """Taluks by district and, for addresses whose district is unknown or has none, by state."""
    known = postal.filter(F.length("taluk") > 0)
    own = known.filter(F.length("district") > 0).select(
        "state", "district", _scope("state", "district").alias("scope"), "taluk").distinct()
    whole = known.select(_scope("state", None).alias("scope"), F.col("taluk").alias("name"))
    names = own.select("scope", F.col("taluk").alias("name")).union(whole).distinct()
    return names, own.select("state", "district", "scope").distinct()


def _scope(state, district):
    return F.to_json(F.array(col(state), F.lit("") if district is None else col(district)))


def find_taluks(texts: DataFrame, postal: DataFrame) -> DataFrame:
    """``texts`` (state, district, address, told, market, …) with taluk and taluk_rule.

    ``postal`` has state, district and taluk. Taluks of the known district count, else
    those of the state. The first rule that finds one decides: 1. the words around
    "mandal", "tehsil" or "taluk" are one edit from a name; 2. a name occurs in the
    market's name; 3. a name occurs in the address, less the words its district was
    told by, but not as that of a road; 4. a longer word of it is within two edits of
    a name. Market may be NULL. Equal texts are searched once.
    """
    names, scopes = _taluk_index(postal)
    placed = texts.join(scopes, ["state", "district"], "left").withColumns({
        "scope": F.coalesce("scope", _scope("state", None)),
        "_rest": without_words("address", "told"),
        "_named": F.coalesce(replace_whole("market", MARKET_TALUK_ALIASES), F.lit(""))})
    keys = ["scope", "address", "_rest", "_named"]
    once = materialise(placed.filter(F.length("address") > 0).select(*keys).distinct(),
                       "taluk-texts")
    held = once.select(*keys, F.inline(F.array(
        F.struct(F.lit(2).alias("rule"), F.col("_named").alias("text")),
        F.struct(F.lit(3).alias("rule"), F.col("_rest").alias("text")))))
    hits = occurrences(held, names.withColumn("spelling", F.col("name")))
    held = held.join(hits, ["scope", "text"])
    for suffix in TALUK_FALSE_SUFFIXES:
        as_road = F.contains("text", F.concat("name", F.lit(suffix)))
        held = held.filter((F.col("rule") == 2) | ~as_road)
    held = held.select(*keys, "rule", "name", (-F.length("name")).cast("double").alias("score"))

    marked = F.transform(_windows("address", TALUK_WINDOW),
                         lambda w: F.trim(F.regexp_replace(w, r"\d", "")))
    long_words = F.filter(F.split("_rest", " "),
                          lambda w: (F.length(w) >= 4) & ~w.isin(*TALUK_STOPWORDS))
    said = once.select(*keys, F.inline(F.concat(_phrases(1, marked), _phrases(4, long_words))))
    meant = said.join(near_names(said, names), ["scope", "phrase"]).filter(
        F.col("distance") <= edit_allowance("phrase", F.when(F.col("rule") == 4, 2).otherwise(1)))
    meant = meant.select(*keys, "rule", "name", (-F.col("similarity")).alias("score"))
    best = held.unionByName(meant).groupBy(*keys).agg(_best("name"))
    found = best.select(*keys, F.col("best.name").alias("taluk"),
                        F.col("best.rule").alias("taluk_rule"))
    return placed.join(found, keys, "left").drop("scope", "_rest", "_named")


def assign_districts(addresses: DataFrame, districts: DataFrame, columns=("apmc_address",)
                     ) -> DataFrame:
    """Addresses with the district found in the first of the columns that names one, and the
    words it was told by in each column."""
    texts = [addresses.select("state", F.col(c).alias("address")) for c in columns]
    every = texts[0]
    for more in texts[1:]:
        every = every.union(more)
    found = materialise(find_districts(every, districts), "address-districts")
    out = addresses
    for i, c in enumerate(columns):
        out = out.join(found.select("state", F.col("address").alias(c), F.col("district").alias(
            f"_d{i}"), F.col("told").alias(f"told_{i}"), F.col("rule").alias(f"rule_{i}")),
            ["state", c], "left")
    return out.withColumn("district", F.coalesce(*[f"_d{i}" for i in range(len(columns))])).drop(
        *[f"_d{i}" for i in range(len(columns))])
