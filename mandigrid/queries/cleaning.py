"""Names, addresses, codes and raw rows."""

from pyspark.sql import functions as F

from mandigrid.fixed_values import (
    BULLETIN_MARKET_PATTERNS, COMMODITY_CORRECTIONS, COMMODITY_TRANSLATIONS, STATE_CORRECTIONS,
)
from mandigrid.functions import dates, keys, text
from mandigrid.functions.missing import marker_as_null, number, zero_as_null
from mandigrid.operators import locate
from mandigrid.operators.relational import keep_last, keep_one, with_values
from mandigrid.operators.reference_data import bounding_centres
from mandigrid.plans import bulletins
from mandigrid.queries.common import OBS, d, n, present, s
from mandigrid.sources.bulletins import drop_repeated_headers, parse_lines
from mandigrid.sources.sinks import point_features
from mandigrid.sources.standins import (
    documents, observations, places, table,
)


def _count():
    return F.count(F.lit(1)).alias("n")


# p_type and r_name read as the misspelt names they are to be corrected to
_MISSPELT = {"ECONOMY": " Soanf", "LARGE": "Pine Apple ", "MEDIUM": "Colacasia",
             "PROMO": "Paddy(Dhan)", "SMALL": "Bengal Grams(Gram)", "STANDARD": "Astera"}
_STATES = {"AFRICA": "Orissa", "ASIA": " Uttrakhand", "EUROPE": "Chattisgarh"}


def _case(column, mapping):
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {column} END"


def _q(x):
    return "'" + x.replace("'", "''") + "'"


def clean_names(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumns({
        "commodity": text.replace_whole("commodity", _MISSPELT),
        "state": text.replace_whole("state", _STATES)})
    return bulletins.clean_names(obs).groupBy("state", "commodity", "commodity_translated").agg(
        _count())


def other_variety_rule(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    plain = F.col("p_type").isin("ECONOMY", "SMALL")
    rows = part.select(
        F.col("p_type").alias("commodity"),
        F.when(plain & (F.col("p_size") > 25), "Other").when(plain, F.col("p_type"))
        .when(F.col("p_size") > 25, "Other").otherwise(F.col("p_brand")).alias("variety"))
    return bulletins.merge_other_variety(rows).groupBy("commodity", "variety").agg(_count())


def locate_markets(spark, sf_dir):
    """Bulletins write some markets with a trade in brackets; some have no profile."""
    known = places(spark, sf_dir).join(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal"),
        F.col("s_suppkey") == F.col("k")).filter("s_acctbal >= 2000")
    locations = known.select(keys.location_key("state", "market").alias("location_key"),
                             "district", F.col("market").alias("taluk"))
    rows = observations(spark, sf_dir).drop("district").withColumn(
        "market", F.when(F.col("commodity") == "PROMO", F.concat("market", F.lit("(Grain)")))
        .otherwise(F.col("market")))
    return locate.add_location(rows, locations).groupBy(
        "state", "market", "district", "taluk").agg(_count())


def assignment_rate(spark, sf_dir):
    placed = places(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").join(
        placed.filter(F.col("state") != "AFRICA"), F.col("l_suppkey") == F.col("s_suppkey"),
        "left")
    return present(locate.assignment_rate(rows, ["district", "market"], ["l_returnflag"]))


def unassigned(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(
        places(spark, sf_dir).filter(F.col("state") != "AFRICA"), "s_suppkey", "left")
    return locate.unassigned(rows).select("s_suppkey", "s_name")


def regex_corrections(spark, sf_dir):
    written = F.concat(F.col("s_name"), F.lit(" Mkt. Yard (AP)"), F.lit("  Hqs"))
    rows = table(spark, sf_dir, "supplier").select(written.alias("written"))
    return rows.withColumn("name", text.replace_patterns("written", BULLETIN_MARKET_PATTERNS))


def normalize_text(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    address = text.normalize_address("text", F.col("source"))
    return docs.select("doc_id", F.md5(address).alias("digest"),
                       F.length(address).cast("bigint").alias("length"))


def tidy_text(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.md5(text.tidy_punctuation("text")).alias("digest"))


def find_pin(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", text.find_pin("text").alias("pin"))
    return docs.filter(F.col("pin").isNotNull())


def title_case(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    written = F.concat_ws("-", F.upper("p_name"), F.lower("p_brand"), F.lit("o'neil (MDL)"))
    return part.select("p_partkey", text.title(written).alias("title"),
                       text.capwords(written).alias("words"),
                       text.capitalize(written).alias("capital"))


def initials(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.initcap("p_name").alias("name"))
    return present(part.groupBy("name").agg(_count()).withColumn(
        "initials", text.to_initials("name")))


def market_cleaned(spark, sf_dir):
    rows = places(spark, sf_dir).select(
        "market", "district", F.concat("district", F.lit(" ("), "market", F.lit(")"))
        .alias("written"))
    return rows.select("market", text.market_without_district("written", "district")
                       .alias("with_district"),
                       text.market_without_district("market", "district").alias("without"),
                       text.market_without_district(F.concat("district", F.lit(",")), "district")
                       .alias("only_district"))


def origin_split(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("origin", F.when(
        F.col("tonnage") > 25, F.concat_ws("_", "state", "market")).otherwise(F.col("state")))
    state, market = text.split_origin("origin")
    return rows.groupBy(state.alias("origin_state"), market.alias("origin_market")).agg(_count())


def established_year(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("written"))
    return present(rows.groupBy(dates.established("written").alias("established")).agg(
        _count(), F.min(F.col("written").cast("bigint")).alias("first")))


def missing_markers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    written = F.when(F.col("l_tax") == 0.08, "NR").when(F.col("l_tax") == 0.07, " * ").when(
        F.col("l_tax") == 0.06, "NaN").otherwise(F.col("l_quantity").cast("string"))
    rows = lines.select(
        "l_returnflag", number(written).alias("value"), marker_as_null(written).alias("text"),
        text.per_kg(written).alias("kg"),
        zero_as_null(F.col("l_discount") * 1.0).alias("zero"))
    return present(rows.groupBy("l_returnflag").agg(
        F.count("value").alias("numbers"), F.count("text").alias("texts"),
        F.count("zero").alias("nonzero"), F.sum(F.nanvl("kg", F.lit(0.0)) * 100).alias("kg")))


def enough_values(spark, sf_dir):
    obs = observations(spark, sf_dir).select("state", "tonnage", "modal_price", "min_price")
    return with_values(obs, 2).groupBy("state").agg(_count())


def dedupe_keep_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return present(keep_last(events, ["user_id", "event_type"], "event_id"))


def dedupe_keep_first(spark, sf_dir):
    obs = observations(spark, sf_dir).select("date", "state", "commodity", "variety", "tonnage")
    return present(keep_one(obs, ["date", "state"], ["commodity", "variety"]))


def storage_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat(F.initcap("p_name"), F.lit(" ("), "p_type", F.lit(")"))
    return part.select(
        "p_partkey", keys.collection_key("p_name", "market", "varieties").alias("collection"),
        keys.file_key(F.concat(F.lit('"'), "p_name", F.lit(', x"'))).alias("file"),
        keys.stack_key(name).alias("stack"),
        keys.series_id(F.lit("state"), F.col("p_brand"), F.col("p_type")).alias("series"))


_CELLS = ["date", "state", "market", "category", "commodity", "variety", "tonnage", "min_price",
          "max_price", "modal_price"]


def bulletin_lines(spark, sf_dir):
    """Bulletin rows written as text lines of two widths, and read back."""
    obs = observations(spark, sf_dir).select(
        F.date_format("date", "dd/MM/yyyy").alias("date"), "state", "market", "category",
        "commodity", "variety", "tonnage", F.round("min_price").alias("min_price"),
        F.round("max_price").alias("max_price"), F.round("modal_price").alias("modal_price"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _CELLS]
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) if i == 2 else c for i, c in enumerate(cells)]
    line = F.when(F.col("commodity") == "PROMO", F.concat_ws(
        ",", *quoted, F.lit('"Far, State"'), F.col("market"))).otherwise(
        F.concat_ws(",", *cells))
    parsed = parse_lines(obs.select(line.alias("value")))
    return present(parsed.groupBy("date", "state", "commodity", "origin_state").agg(
        _count(), F.count("origin_market").alias("origins"), F.sum("tonnage").alias("tonnage"),
        F.sum(F.floor("modal_price")).alias("price")))


def repeated_headers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") == 1, "state").otherwise(F.col("l_returnflag")).alias("a"),
        F.when(F.col("l_linenumber") == 2, "coverage").otherwise(F.col("l_linestatus")).alias("b"))
    return drop_repeated_headers(lines, ["state", "coverage"]).groupBy("a", "b").agg(_count())


def raw_bulletin(spark, sf_dir):
    """Each day of events is a page: some events bring a heading cell, all bring a row."""
    events = table(spark, sf_dir, "events").drop("props")
    value = F.round("value")
    page = [F.col("ts").cast("date").cast("string").alias("page")]
    tonnage = F.when(F.col("value") > 80, F.lit("NR")).when(
        F.col("value") > 40, F.lit("")).otherwise(value.cast("string"))
    rows = events.select(
        *page, (F.col("event_id") * 2 + 1).alias("row_no"),
        F.date_format("ts", "dd/MM/yyyy").alias("date"), F.lit("Grain").alias("category"),
        F.lit("Rice").alias("commodity"),
        F.array(F.when(F.col("event_type") == "click", F.concat(F.lit("M"), "user_id"))
                .otherwise(""), tonnage,
                F.when(F.col("value") > 10, "Home_Town").otherwise("Away"),
                F.col("event_type"), F.lit("FAQ"), F.lit("100"), F.lit("NR"),
                value.cast("string")).alias("cells"))
    headings = events.filter(F.col("event_type") == "view").select(
        *page, (F.col("event_id") * 2).alias("row_no"), F.lit("").alias("date"),
        F.lit("").alias("category"), F.lit("").alias("commodity"),
        F.array(F.concat(F.lit("State "), "user_id")).alias("cells"))
    out = bulletins.normalise_raw_bulletin(headings.unionByName(rows))
    return present(out.select("page", "row_no", "date", "state", "market", "variety", "grade",
                              "tonnage", "min_price", "max_price", "modal_price",
                              "origin_state", "origin_market"))


def point_feature_lines(spark, sf_dir):
    markets = places(spark, sf_dir).join(
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey").select(
        F.col("s_suppkey").alias("id"), F.col("market").alias("name"), "state",
        F.when(F.col("district") != "NATION_3", F.col("district")).alias("district"),
        F.round("s_acctbal").cast("int").alias("lng"), F.lit(12).alias("lat"))
    return point_features(markets)


def bbox_centre(spark, sf_dir):
    """Customers as boundary points of their nation."""
    points = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("name"),
        F.struct(F.col("c_acctbal").alias("lat"), F.col("c_custkey").cast("double").alias("lng"))
        .alias("p"))
    return present(bounding_centres(points, "name", "p"))


# --- SQL -------------------------------------------------------------------

_SPACES = r"'^\s+|\s+$'"


def _strip(x):
    return f"regexp_replace({x}, {_SPACES}, '', 'g')"


_words = (r"array_to_string(list_transform(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')),"
          r" ' '), lambda w: replace(upper(w[1]), 'ẞ', 'Ss') || lower(w[2:])), ' ')")


def _chain(x, *steps):
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_NORMAL = _words.format(_chain(
    "replace(" + _chain("text", (",", " , "), ("[!-+\\-./:-@\\[-`{{-~]".replace("{{", "{"), " "),
                        (r"\d+", " "), (r"(?i)\sPin\s", " ")) + ", source, '')",
    (r"\s+$", ""), (",+$", ""), ("([a-z])([A-Z])", r"\1 \2")))
_NORMAL = _chain(_NORMAL, ("(?i)Disst", "Dist"), ("(?i)Dis ", "Dist "))

_TITLE = (r"array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z]+|[^a-z]+'),"
          r" lambda w: upper(w[1]) || w[2:]), '')")
_WRITTEN = "(upper(p_name) || '-' || lower(p_brand) || '-o''neil (MDL)')"

_PATTERNS = "written"
for _p, _r in BULLETIN_MARKET_PATTERNS.items():
    _PATTERNS = f"regexp_replace({_PATTERNS}, {_q(_p)}, {_q(_r)}, 'g')"

_YEAR = """CASE WHEN p_partkey = 0 THEN NULL
  WHEN p_partkey < 10 THEN p_partkey + 2000
  WHEN p_partkey < 100 THEN CASE WHEN p_partkey >= 59 THEN p_partkey + 1900 ELSE p_partkey + 2000 END
  WHEN p_partkey < 1000 THEN p_partkey * 10
  WHEN p_partkey < 10000 THEN p_partkey END"""

QUERIES = {
    "clean_names": (clean_names, f"""WITH {OBS},
a AS (SELECT trim({_case('state', _STATES)}) AS state, trim({_case('commodity', _MISSPELT)})
      AS commodity FROM obs),
b AS (SELECT {_case('state', STATE_CORRECTIONS)} AS state,
             {_case('commodity', COMMODITY_CORRECTIONS)} AS commodity FROM a)
SELECT state, commodity, {_case('commodity', COMMODITY_TRANSLATIONS)} AS commodity_translated,
       {n('count(*)')} AS n
FROM b GROUP BY ALL"""),
    "other_variety_rule": (other_variety_rule, f"""
WITH r AS (SELECT p_type AS commodity, CASE
    WHEN p_type IN ('ECONOMY', 'SMALL') AND p_size > 25 THEN 'Other'
    WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type
    WHEN p_size > 25 THEN 'Other' ELSE p_brand END AS variety FROM part),
v AS (SELECT commodity, list_sort(list(DISTINCT variety)) AS vs FROM r GROUP BY commodity)
SELECT r.commodity, CASE WHEN vs = list_sort([r.commodity, 'Other']) THEN r.commodity
       ELSE variety END AS variety, {n('count(*)')} AS n
FROM r JOIN v ON r.commodity = v.commodity GROUP BY ALL"""),
    "locate_markets": (locate_markets, f"""WITH {OBS},
known AS (SELECT r_name || '_' || s_name AS k, n_name, s_name FROM supplier
          JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          WHERE s_acctbal >= 2000),
o AS (SELECT state, market || CASE WHEN commodity = 'PROMO' THEN '(Grain)' ELSE '' END AS market
      FROM obs)
SELECT state, market, n_name AS district, s_name AS taluk, {n('count(*)')} AS n
FROM o LEFT JOIN known ON k = regexp_replace(state || '_' || market, '\\(.*\\)', '')
GROUP BY ALL"""),
    "assignment_rate": (assignment_rate, f"""
SELECT l_returnflag, {n('count(*)')} AS n,
       {s("sum(CASE WHEN r_name <> 'AFRICA' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)")}
         AS district_rate,
       {s("sum(CASE WHEN r_name <> 'AFRICA' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE)")}
         AS market_rate
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY l_returnflag"""),
    "unassigned": (unassigned, """
SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'"""),
    "regex_corrections": (regex_corrections, f"""
WITH r AS (SELECT s_name || ' Mkt. Yard (AP)' || '  Hqs' AS written FROM supplier)
SELECT written, {_PATTERNS} AS name FROM r"""),
    "normalize_text": (normalize_text, f"""
WITH r AS (SELECT doc_id, {_NORMAL} AS a FROM documents)
SELECT doc_id, md5(a) AS digest, {n('length(a)')} AS length FROM r"""),
    "tidy_text": (tidy_text, f"""
SELECT doc_id, md5({_chain('text', (chr(92) + 's' + chr(92) + ')', ')'),
                           (chr(92) + '(' + chr(92) + ')', ''), (chr(92) + 's+', ' '),
                           (chr(92) + 's+,' + chr(92) + 's*', ', '), (chr(92) + 's*,$', ''))})
       AS digest
FROM documents"""),
    "find_pin": (find_pin, r"""
WITH r AS (SELECT doc_id, nullif(regexp_extract(text, '\d{6}'), '') AS a,
                  nullif(regexp_replace(regexp_extract(text, '\d{3}\s\d{3}'), '\s', ''), '') AS b
           FROM documents)
SELECT doc_id, coalesce(a, b) AS pin FROM r WHERE coalesce(a, b) IS NOT NULL"""),
    "title_case": (title_case, f"""
SELECT p_partkey, {_TITLE.format(_WRITTEN)} AS title, {_words.format(_WRITTEN)} AS words,
       upper({_WRITTEN}[1]) || lower({_WRITTEN}[2:]) AS capital
FROM part"""),
    "initials": (initials, f"""
WITH r AS (SELECT {_words.format('p_name')} AS name FROM part),
g AS (SELECT name, {n('count(*)')} AS n, string_split(name, ' ') AS w FROM r GROUP BY name)
SELECT name, n, ' ' || lower(w[1][1]) || ' ' || lower(w[2][1]) || ' , ' || w[1][1] || ' '
       || w[2][1] || ' , ' || w[1][1] || w[2][1] || ' , ' || w[1][1] || ' ' || w[2] || ' '
       AS initials
FROM g"""),
    "market_cleaned": (market_cleaned, """
SELECT s_name AS market, s_name AS with_district, s_name AS without, n_name AS only_district
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "origin_split": (origin_split, f"""WITH {OBS}
SELECT state AS origin_state, CASE WHEN tonnage > 25 THEN market ELSE state END AS origin_market,
       {n('count(*)')} AS n
FROM obs GROUP BY ALL"""),
    "established_year": (established_year, f"""
WITH r AS (SELECT p_partkey, {_YEAR} AS y FROM part)
SELECT CAST(make_date(CAST(y AS BIGINT), 1, 1) AS VARCHAR) AS established,
       {n('count(*)')} AS n, {n('min(p_partkey)')} AS first
FROM r GROUP BY y"""),
    "missing_markers": (missing_markers, f"""
SELECT l_returnflag, {n("sum(CASE WHEN l_tax NOT IN (0.06, 0.07, 0.08) THEN 1 ELSE 0 END)")}
       AS numbers, {n("sum(CASE WHEN l_tax NOT IN (0.07, 0.08) THEN 1 ELSE 0 END)")} AS texts,
       {n("sum(CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END)")} AS nonzero,
       {s("sum(CASE WHEN l_tax NOT IN (0.06, 0.07, 0.08) THEN l_quantity / 100 * 100 END)")} AS kg
FROM lineitem GROUP BY l_returnflag"""),
    "enough_values": (enough_values, f"""WITH {OBS}
SELECT state, {n('count(*)')} AS n FROM obs
WHERE 1 + CAST(tonnage IS NOT NULL AS INT) + CAST(modal_price IS NOT NULL AS INT)
        + CAST(min_price IS NOT NULL AS INT) >= 2 GROUP BY state"""),
    "dedupe_keep_last": (dedupe_keep_last, f"""
SELECT user_id, event_type, event_id, {s('value')} AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"""),
    "dedupe_keep_first": (dedupe_keep_first, f"""WITH {OBS}
SELECT {d('date')} AS date, state, commodity, variety, {s('tonnage')} AS tonnage FROM obs
QUALIFY row_number() OVER (PARTITION BY obs.date, state
                           ORDER BY commodity, variety, obs.tonnage NULLS FIRST) = 1"""),
    "storage_keys": (storage_keys, """
SELECT p_partkey, 'market.' || replace(p_name, ' ', '.') || '.varieties' AS collection,
       replace(regexp_replace(replace(p_name || ', x', ',', ' '), '\\s+', ' ', 'g'), ' ', '-')
         AS file,
       (upper(p_name[1]) || lower(string_split(p_name, ' ')[1][2:]) || '-'
        || upper(string_split(p_name, ' ')[2][1]) || string_split(p_name, ' ')[2][2:] || '_'
        || p_type) AS stack,
       'state.' || p_brand || '.' || p_type || '.avg' AS series
FROM part"""),
    "bulletin_lines": (bulletin_lines, f"""WITH {OBS}
SELECT {d('date')} AS date, state, commodity,
       CASE WHEN commodity = 'PROMO' THEN 'Far, State' END AS origin_state,
       {n('count(*)')} AS n, {n("sum(CASE WHEN commodity = 'PROMO' THEN 1 ELSE 0 END)")} AS origins,
       {s('sum(tonnage)')} AS tonnage, {n('sum(round(modal_price))')} AS price
FROM obs GROUP BY date, state, commodity"""),
    "repeated_headers": (repeated_headers, f"""
SELECT l_returnflag AS a, l_linestatus AS b, {n('count(*)')} AS n
FROM lineitem WHERE l_linenumber NOT IN (1, 2) GROUP BY ALL"""),
    "raw_bulletin": (raw_bulletin, f"""
WITH r AS (
  SELECT *, event_id * 2 + 1 AS row_no, {d('ts')} AS page,
         CASE WHEN value > 80 THEN 'NR' WHEN value > 40 THEN NULL
              ELSE CAST(round(value) AS VARCHAR) END AS q,
         CASE WHEN event_type = 'click' THEN 'M' || user_id END AS m,
         CASE WHEN event_type = 'view' THEN 'State ' || user_id END AS st
  FROM events),
f AS (
  SELECT *, last_value(q IGNORE NULLS) OVER w AS fq, last_value(m IGNORE NULLS) OVER w AS fm,
         last_value(st IGNORE NULLS) OVER w AS fs
  FROM r WINDOW w AS (PARTITION BY page ORDER BY row_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT page, {n('row_no')} AS row_no, page AS date, fs AS state, fm AS market,
       event_type AS variety, 'FAQ' AS grade,
       {s('TRY_CAST(fq AS DOUBLE)')} AS tonnage, {s('CAST(1.0 AS DOUBLE)')} AS min_price,
       CAST(NULL AS DOUBLE) AS max_price, {s('round(value) / 100')} AS modal_price,
       CASE WHEN value > 10 THEN 'Home' ELSE 'Away' END AS origin_state,
       CASE WHEN value > 10 THEN 'Town' ELSE 'Away' END AS origin_market
FROM f"""),
    "point_features": (point_feature_lines, """
SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":['
       || CAST(CAST(round(s_acctbal) AS INT) AS VARCHAR) || ',12]},"id":' || s_suppkey
       || ',"properties":{"name":"' || s_name || '","state":"' || r_name || '","district":'
       || CASE WHEN n_name = 'NATION_3' THEN 'null' ELSE '"' || n_name || '"' END || '}}' AS value
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "bbox_centre": (bbox_centre, f"""
SELECT {n('c_nationkey')} AS name, {s('(min(c_acctbal) + max(c_acctbal)) / 2')} AS lat,
       {s('(min(c_custkey) + max(c_custkey)) / CAST(2 AS DOUBLE)')} AS lng
FROM customer GROUP BY c_nationkey"""),
}
