"""Addresses read by rule; the twins try every rule on every name of a state."""

from pyspark.sql import functions as F

from mandigrid.functions.text import capwords, normalize_address
from mandigrid.operators import addresses
from mandigrid.queries.common import n, present
from mandigrid.queries.matching import _damaged, damaged, sims
from mandigrid.sources.standins import table, with_places


def _lines(spark, sf_dir):
    """Order lines with the two words of their part's name, in lower case, and a form."""
    lines = with_places(table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_linenumber"), spark, sf_dir)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    first, second = (F.element_at(F.split("p_name", " "), i) for i in (1, 2))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.when(F.col("state") == "ASIA", "Bihar").otherwise(F.col("state")).alias("state"),
        F.concat(F.lit("Nation "), F.char(F.ascii("district") % 26 + 65)).alias("district"),
        first.alias("first"), second.alias("second"), (F.col("l_linenumber") % 7).alias("form"))


def _choose(forms):
    out = F.lit(None).cast("string")
    for i, text in enumerate(forms):
        out = F.when(F.col("form") == i, text).otherwise(out)
    return out


def address_district(spark, sf_dir):
    """Markets' addresses: plain, misspelt, by initials, by a single word, corrected by the
    state's table, and two that name no district."""
    rows = _lines(spark, sf_dir).select("state", "first", "second", "form").groupBy(
        "state", "first", "second", "form").agg(F.count(F.lit(1)).alias("n"))
    end = F.concat(F.lit("-534001, "), "state")
    wrong = [_damaged("first"), _damaged("second")]
    initials = [F.upper(F.substring(c, 1, 1)) for c in ("first", "second")]
    written = _choose([
        F.concat(F.lit("No. 7 Mill, DISST "), F.concat_ws(" ", "first", "second"), end),
        F.concat(F.lit("No. 7 Mill, Dist "), F.concat_ws(" ", *wrong), end),
        F.concat(F.lit("No. 7 Mill "), F.concat_ws(" ", *initials), F.lit(" Area"), end),
        F.concat(F.lit("No. 7 Mill, "), wrong[1], end), F.concat(F.lit("Quay House"), end),
        F.concat(F.lit("Purnea Gate, "), wrong[1], end), F.concat(F.lit("Anaj, Mandi"), end)])
    read = rows.select("state", "n", normalize_address(written, "state").alias("address"))
    texts = read.groupBy("state", "address").agg(F.sum("n").alias("n"))
    name = capwords(F.concat_ws(" ", "first", "second"))
    units = rows.select("state", F.explode(F.array(
        name, capwords("second"), F.lit("Purnia"), F.lit("Bundi"))).alias("district"))
    out = addresses.assign_districts(texts, units, ["address"])
    return present(out.select("state", "address", "n", "district", F.col("rule_0").alias("rule"),
                              F.col("told_0").alias("told")))


def address_taluk(spark, sf_dir):
    """Addresses that tell a taluk before a marker, misspelt, by the market, beside a road of
    its name, by a misspelt word, not at all, or without a district."""
    rows = _lines(spark, sf_dir).groupBy("state", "district", "first", "second", "form").agg(
        F.count(F.lit(1)).alias("n"))
    first, second = capwords("first"), capwords("second")
    full = F.concat_ws(" ", first, second)
    dist = F.concat(F.lit(" , Dist "), "district")
    misspelt = F.concat(F.lit(" , Dist "), _damaged("district"))
    text = _choose([
        F.concat(F.lit("Mill Street , "), full, F.lit(" Mandal"), dist),
        F.concat(_damaged(second), F.lit(" Tehsil , Mill Street"), dist),
        F.concat(F.lit("Mill Street"), dist),
        F.concat(full, F.lit(" , Station Area"), misspelt),
        F.concat(second, F.lit(" Road , Near "), _damaged(_damaged(second)), dist),
        F.concat(F.lit("Fort"), dist), F.concat(full, F.lit(" Raj , "), first, F.lit(" Gate"))])
    market = F.when(F.col("form") == 2, F.concat(full, F.lit(" Yard")))
    texts = rows.select("state", text.alias("address"), market.alias("market"), "n").groupBy(
        "state", "address", "market").agg(F.sum("n").alias("n"))
    postal = rows.filter(F.col("form") != 5).select("state", "district", F.explode(F.array(
        full, second)).alias("taluk")).distinct()
    placed = addresses.assign_districts(texts, postal, ["address"]).withColumnRenamed(
        "told_0", "told")
    out = addresses.find_taluks(placed, postal)
    return present(out.select("state", "address", "market", "n", "district",
                              F.col("rule_0").alias("district_rule"), "taluk", "taluk_rule"))


# --- SQL -------------------------------------------------------------------

_CAP = "(upper({0}[1]) || {0}[2:])"


def _cap(x):
    return _CAP.format(x)


_LINES = """lines AS (
  SELECT CASE r_name WHEN 'ASIA' THEN 'Bihar' ELSE r_name END AS state,
         'Nation ' || chr(ascii(n_name) % 26 + 65) AS district,
         string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[2] AS second,
         l_linenumber % 7 AS form
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _initials(a, b):
    """All spellings of the initials of a name of two words."""
    return (f"[' ' || lower({a}[1] || ' ' || {b}[1]) || ' ', ' ' || {a}[1] || ' ' || {b}[1] || ' ',"
            f" ' ' || {a}[1] || {b}[1] || ' ', ' ' || {a}[1] || ' ' || {b} || ' ']")


def _district_ctes():
    """CTEs that end in ``dbest`` (state, address, district, rule, told), from ``texts`` (state,
    address) and ``names`` (state, d)."""
    window = r"(?i)((?:\w+\s+){0,2})\S*(?:dist|dt)\S*((?:\s+\w+){0,2})"
    return rf"""
phrases AS (
  SELECT state, address, 2 AS rule, place, 2 AS k,
         trim(CASE place WHEN 1 THEN regexp_extract(address, '{window}', 1)
              ELSE regexp_extract(address, '{window}', 2) END) AS phrase
  FROM texts, (SELECT unnest([1, 2]) AS place) WHERE regexp_matches(address, '{window}') UNION ALL
  SELECT state, address, 4, 0, 1, unnest(string_split(string_split(address, ', ')[-1], ' '))
  FROM texts),
near AS (
  SELECT p.*, d FROM phrases p JOIN names USING (state) WHERE levenshtein(lower(phrase), lower(d)) <= k
  AND NOT (rule = 4 AND (phrase = 'Khada'
           OR phrase = 'Mandi' AND d IN ('Bundi', 'Banda', 'Gonda')))),
{sims('near', 'phrase', 'd', 'dsim')},
dfound AS (
  SELECT state, address, 1 AS rule, -CAST(length(d) AS DOUBLE) AS score, d, 0 AS place, '' AS phrase
  FROM texts JOIN names USING (state) WHERE contains(address, d) UNION ALL
  SELECT state, address, rule, -similarity, d, place, phrase
  FROM near JOIN dsim ON dsim.a = phrase AND dsim.b = d UNION ALL
  SELECT state, address, 3, 0, d, 0, '' FROM texts
  JOIN (SELECT state, d, string_split(d, ' ') AS w FROM names) USING (state)
  WHERE len(w) = 2 AND len(w[2]) > 1
  AND len(list_filter({_initials('w[1]', 'w[2]')}, lambda i: contains(address, i))) > 0),
told AS (
  SELECT state, address, phrase AS told FROM dfound WHERE rule = 2 AND phrase <> ''
  QUALIFY row_number() OVER (PARTITION BY state, address ORDER BY place DESC, phrase DESC) = 1),
dbest AS (
  SELECT f.state, f.address, d AS district, rule, CASE WHEN rule > 1 THEN told END AS told
  FROM dfound f LEFT JOIN told t ON t.state = f.state AND t.address = f.address
  QUALIFY row_number() OVER (PARTITION BY f.state, f.address ORDER BY rule, score, d) = 1)"""


_W1, _W2 = damaged("first"), damaged("second")
_DISTRICT = f"""WITH {_LINES},
written AS (
  SELECT state, CASE form
    WHEN 0 THEN 'No Mill , Dist ' || {_cap('first')} || ' ' || {_cap('second')}
    WHEN 1 THEN 'No Mill , Dist ' || {_cap(_W1)} || ' ' || {_cap(_W2)}
    WHEN 2 THEN 'No Mill ' || upper(first[1]) || ' ' || upper(second[1]) || ' Area'
    WHEN 3 THEN 'No Mill , ' || {_cap(_W2)} WHEN 4 THEN 'Quay House'
    WHEN 5 THEN CASE state WHEN 'Bihar' THEN 'Purnia' ELSE 'Purnea' END || ' Gate , ' || {_cap(_W2)}
    ELSE 'Anaj , Mandi' END AS address
  FROM lines),
texts AS (SELECT state, address, {n('count(*)')} AS n FROM written GROUP BY state, address),
names AS (SELECT DISTINCT state, unnest([{_cap('first')} || ' ' || {_cap('second')},
                                  {_cap('second')}, 'Purnia', 'Bundi']) AS d FROM lines),
{_district_ctes()}
SELECT t.state, t.address, n, b.district, {n('b.rule')} AS rule, b.told FROM texts t
LEFT JOIN dbest b ON b.state = t.state AND b.address = t.address"""

_F, _S = _cap("first"), _cap("second")
_TWICE = damaged(damaged(_S))
_TALUK_WINDOW = r"(?i)((?:\w+\s+){0,1})\S*(?:mdl|mandal|tehsil|taluk)\S*((?:\s+\w+){0,1})"
_TALUK = rf"""WITH {_LINES},
written AS (
  SELECT state, CASE form
    WHEN 0 THEN 'Mill Street , ' || {_F} || ' ' || {_S} || ' Mandal , Dist ' || district
    WHEN 1 THEN {damaged(_S)} || ' Tehsil , Mill Street , Dist ' || district
    WHEN 2 THEN 'Mill Street , Dist ' || district
    WHEN 3 THEN {_F} || ' ' || {_S} || ' , Station Area , Dist ' || {damaged('district')}
    WHEN 4 THEN {_S} || ' Road , Near ' || {_TWICE} || ' , Dist ' || district
    WHEN 5 THEN 'Fort , Dist ' || district
    ELSE {_F} || ' ' || {_S} || ' Raj , ' || {_F} || ' Gate' END AS address,
    CASE WHEN form = 2 THEN {_F} || ' ' || {_S} || ' Yard' END AS market
  FROM lines),
markets AS (SELECT state, address, market, {n('count(*)')} AS n FROM written GROUP BY ALL),
texts AS (SELECT DISTINCT state, address FROM markets),
postal AS (SELECT DISTINCT state, district, unnest([{_F} || ' ' || {_S}, {_S}]) AS taluk
           FROM lines WHERE form <> 5),
names AS (SELECT DISTINCT state, district AS d FROM postal),
{_district_ctes()},
placed AS (
  SELECT m.*, b.district, b.rule AS district_rule,
         b.district IN (SELECT district FROM postal p WHERE p.state = m.state) IS TRUE AS known,
         CASE WHEN length(b.told) > 0 AND length(m.address) - length(replace(m.address, b.told, ''))
                   = length(b.told)
              THEN regexp_replace(regexp_replace(regexp_replace(replace(m.address, b.told, ''),
                                  '\s+$', ''), ',+$', ''), '\s+', ' ', 'g')
              ELSE m.address END AS rest
  FROM markets m LEFT JOIN dbest b ON b.state = m.state AND b.address = m.address),
pool AS (SELECT DISTINCT m.state, m.address, m.market, m.rest, p.taluk FROM placed m JOIN postal p
         ON p.state = m.state AND (NOT known OR p.district = m.district)),
tried AS (
  SELECT *, 1 AS rule, 1 AS k, trim(CASE place WHEN 1 THEN regexp_extract(address, '{_TALUK_WINDOW}', 1)
         ELSE regexp_extract(address, '{_TALUK_WINDOW}', 2) END) AS phrase
  FROM pool, (SELECT unnest([1, 2]) AS place) WHERE regexp_matches(address, '{_TALUK_WINDOW}')
  UNION ALL
  SELECT * FROM (SELECT *, 0, 4, 2, unnest(string_split(rest, ' ')) AS phrase FROM pool)
  WHERE length(phrase) >= 4 AND phrase NOT IN ('Dist', 'Distt', 'Dt', 'Mandi', 'Road', 'Yard',
        'Secretary', 'Committee', 'Agricultural', 'Konya')),
close AS (SELECT * FROM tried WHERE levenshtein(lower(phrase), lower(taluk)) <= k),
{sims('close', 'phrase', 'taluk', 'tsim')},
tfound AS (
  SELECT state, address, market, rule, -similarity AS score, taluk FROM close
  JOIN tsim ON tsim.a = phrase AND tsim.b = taluk UNION ALL
  SELECT state, address, market, 2, -length(taluk), taluk FROM pool WHERE contains(market, taluk)
  UNION ALL
  SELECT state, address, market, 3, -length(taluk), taluk FROM pool WHERE contains(rest, taluk)
  AND NOT contains(rest, taluk || ' Road') AND NOT contains(rest, taluk || ' Raj')),
tbest AS (SELECT * FROM tfound QUALIFY row_number() OVER (
            PARTITION BY state, address, market ORDER BY rule, score, taluk) = 1)
SELECT p.state, p.address, p.market, n, p.district, {n('district_rule')} AS district_rule, t.taluk,
       {n('t.rule')} AS taluk_rule
FROM placed p LEFT JOIN tbest t ON t.state = p.state AND t.address = p.address
AND t.market IS NOT DISTINCT FROM p.market"""

QUERIES = {
    "address_district": (address_district, _DISTRICT),
    "address_taluk": (address_taluk, _TALUK),
}
