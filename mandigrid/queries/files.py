"""Files written from the tables and read back, and operators of single columns.

Folders are fresh ones below the session's shared folder.
"""

from pyspark.sql import functions as F

from mandigrid.operators.quality import ratio_to_count
from mandigrid.operators.relational import exclude_row
from mandigrid.operators.timeseries import label_headings
from mandigrid.plans.reference_tables import clean_census, staff_total
from mandigrid.queries.common import OBS, d, n, present, s
from mandigrid.session import shared_dir
from mandigrid.sources import bulletins, dimensions, sinks
from mandigrid.sources.standins import districts, observations, places, table


def _text(spark, df, purpose):
    path = shared_dir(spark, purpose)
    df.write.text(path)
    return path


def _lines(spark, sf_dir):
    """Bulletin rows as lines of the current widths, by variety, and a few of no known width."""
    obs = observations(spark, sf_dir)
    cell = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "state", "market", "category", "commodity", "variety", "tonnage", "modal_price")}
    day = F.date_format("date", "dd/MM/yyyy")
    first = [day, cell["state"], cell["market"], cell["category"], cell["commodity"], cell["variety"], cell["tonnage"]]
    price, grade = [F.lit("1"), F.lit("2"), cell["modal_price"]], F.lit("FAQ")
    origin = [F.lit('"Far, State"'), cell["market"]]
    return obs, {
        0: [*first, *price], 1: [*first, grade, *price], 2: [*first, *price, *origin],
        3: [*first, grade, *price[:2], *origin, price[2]], 4: first[:3]}


def _by_number(parts):
    """A line for each row: the layout numbered by the brand's last digit modulo five."""
    k = F.substring("variety", -1, 1).cast("int") % 5
    line = None
    for i, columns in parts.items():
        value = F.concat_ws(",", *columns)
        line = F.when(k == i, value) if line is None else line.when(k == i, value)
    return line


def bulletin_files(spark, sf_dir):
    """Files with lines of 10 to 13 fields, and the lines that no layout has, counted."""
    obs, parts = _lines(spark, sf_dir)
    path = _text(spark, obs.select(_by_number(parts).alias("value")), "bulletins")
    read = bulletins.read_bulletins(spark, path)
    rejected = bulletins.unreadable_lines(spark.read.text(path))
    return present(read.groupBy("date", "state", "grade", "origin_state").agg(
        F.count("*").alias("n"), F.count("origin_market").alias("origins"),
        F.sum("tonnage").alias("tonnage"), F.sum("modal_price").alias("price")).withColumn("readable", F.lit(1)).unionByName(
        rejected.agg(F.count("*").alias("n")).withColumn("readable", F.lit(0)), allowMissingColumns=True))


def older_files(spark, sf_dir):
    """The older widths 9 to 11; a name broken up by its commas is joined again."""
    obs = observations(spark, sf_dir)
    cell = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tonnage", "modal_price")}
    first = [F.date_format("date", "dd/MM/yyyy"), F.col("state"), F.col("market")]
    price, k = [F.lit("1"), F.lit("2"), cell["modal_price"]], F.substring("variety", -1, 1).cast("int") % 3
    line = (F.when(k == 0, F.concat_ws(",", *first, "commodity", "variety", cell["tonnage"], *price))
            .when(k == 1, F.concat_ws(",", *first, "commodity", "variety", cell["tonnage"], F.lit("FAQ"), *price))
            .otherwise(F.concat_ws(",", *first, "commodity", F.lit(" split"), F.lit(" up "), "variety", cell["tonnage"], *price)))
    read = bulletins.read_bulletins(spark, _text(spark, obs.select(line.alias("value")), "older"), "older")
    return present(read.groupBy("state", "commodity", "grade").agg(
        F.count("*").alias("n"), F.sum("tonnage").alias("tonnage"), F.sum("modal_price").alias("price")))


def split_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("a"), F.concat(
        F.lit(" "), "p_brand").alias("b"), F.when(F.col("p_size") > 20, F.lit(" x ")).alias("c"))
    return bulletins.repair_split_name(part, ["a", "b", "c"])


# Entries of one line of a written dictionary.
_LINE_ENTRIES = 500


def _json_lines(spark, rows, value, purpose):
    """Rows as lines of JSON; a dictionary's members may be spread over any number of them."""
    return _text(spark, rows.select(F.to_json(value).alias("value")), purpose)


def location_dictionary(spark, sf_dir):
    """{state: {district: [market]}} written in lines of bounded length, and read back."""
    rows = places(spark, sf_dir)
    sizes = rows.groupBy("state", "district").agg(F.ceil(F.count("*") / _LINE_ENTRIES).alias("lines"))
    line = F.pmod(F.xxhash64("market"), F.col("lines")).alias("line")
    units = rows.join(sizes, ["state", "district"]).groupBy("state", "district", line).agg(
        F.collect_list("market").alias("markets"))
    tree = F.create_map("state", F.create_map("district", "markets"))
    return dimensions.read_locations(spark, _json_lines(spark, units, tree, "locations"), lines=True)


def market_dictionary(spark, sf_dir):
    """{"State_Market": {...}} of all suppliers."""
    rows = places(spark, sf_dir)
    at = F.struct(F.lower("market").alias("Market_Cleaned"), F.col("market").alias("Market"), F.col("state").alias("State"),
                  F.col("district").alias("District"), F.when(F.col("s_suppkey") % 3 > 0, F.col("district")).alias("Taluk"))
    entry = F.create_map(F.concat_ws("_", "state", "market"), at)
    return dimensions.read_market_locations(spark, _json_lines(spark, rows, entry, "markets"), lines=True)


def selection_dictionary(spark, sf_dir):
    """{category: [commodity]}, a list for each size of part."""
    names = F.concat_ws(" ", "p_name", "p_size")
    rows = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.collect_set(names).alias("names"))
    path = _json_lines(spark, rows, F.create_map("p_type", "names"), "selection")
    return dimensions.read_selection(spark, path, lines=True)


def correction_dictionary(spark, sf_dir):
    """{scope: {wrong: right}} of the names of parts."""
    rows = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    path = _json_lines(spark, rows, F.create_map("p_type", F.create_map(F.upper("p_name"), F.col("p_name"))), "corrections")
    return dimensions.read_corrections(spark, path, lines=True)


def census_dictionary(spark, sf_dir):
    """{level: {unit: {rural|urban|total: {...}, state}}}; a customer is a unit, some lack a kind."""
    rows = table(spark, sf_dir, "customer")

    def kind(area, total):
        return F.struct(area.cast("double").alias("area"), F.struct(F.lit(total).cast("double").alias("total"),
                                                                    F.col("c_custkey").cast("double").alias("work")).alias("population"))

    unit = F.struct(kind(F.col("c_custkey"), 5).alias("rural"), F.when(F.col("c_custkey") % 2 == 0, kind(F.lit(2), 7)).alias("urban"),
                    F.col("c_mktsegment").alias("state"))
    path = _json_lines(spark, rows, F.struct(F.create_map("c_name", unit).alias("Districts")), "census")
    return present(dimensions.read_census(spark, path, lines=True).select("level", "name", "state", "tru", "area", "total", "work", "no_work"))


def csv_report(spark, sf_dir):
    """A report with three decimals; a second one that may not replace it changes nothing."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        (F.sum("l_quantity") / F.count("*")).alias("mean"), F.count("*").alias("n"))
    path = shared_dir(spark, "report")
    sinks.write_csv_report(rows, path)
    sinks.write_csv_report(rows.withColumn("mean", F.lit(0.0)), path, replace=False)
    return spark.read.csv(path, header=True).select("l_returnflag", "mean", F.col("n").cast("bigint").alias("n"))


def excluded_record(spark, sf_dir):
    rows = places(spark, sf_dir).withColumn("regulated", F.col("s_suppkey") % 2 == 0)
    doubled = rows.unionByName(rows.withColumn("regulated", ~F.col("regulated")))
    kept = exclude_row(doubled, "Supplier#000000003")
    return kept.groupBy("market").agg(F.count("*").alias("n"), F.count_if("regulated").alias("regulated"))


def staff(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, "NA").when(
        F.col("c_nationkey") == 4, "*").otherwise(F.col("c_nationkey").cast("string")).alias("a"),
        F.col("c_custkey").cast("string").alias("b"))
    return present(rows.select("c_custkey", staff_total("a", "b").alias("staff")))


def share_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("length"), (100.0 * F.count_if(F.col("o_totalprice") > 100000) / F.count("*")).alias("share"))
    return present(rows.select("o_orderpriority", "length", F.round(ratio_to_count("share", "length")).cast("bigint").alias("count")))


def feature_file(spark, sf_dir):
    """Features of all suppliers in FeatureCollections, one a line, read by their fields."""
    rows = places(spark, sf_dir).select(F.col("s_suppkey").alias("id"), F.col("market").alias("name"), "state", "district",
                                        F.col("s_suppkey").cast("double").alias("lng"), F.lit(1.5).alias("lat"))
    path = shared_dir(spark, "features")
    sinks.write_feature_collection(rows, path)
    shape = ("type string, features array<struct<type:string, geometry:struct<type:string, coordinates:array<double>>,"
             " id:bigint, properties:struct<name:string, state:string, district:string>>>")
    read = spark.read.schema(shape).json(path).select("type", F.explode("features").alias("f"))
    return read.select("type", "f.id", F.col("f.geometry.coordinates")[0].alias("lng"), "f.properties.name", "f.properties.district")


def headed_list(spark, sf_dir):
    """Customers listed under headings with their nation's name, a thousand numbers a list."""
    named = table(spark, sf_dir, "customer").join(
        F.broadcast(districts(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(" ", "district", F.floor(F.col("c_custkey") / 1000)).alias("list"), "district", "c_custkey", "c_name")
    lines = named.select("list", (F.col("c_custkey") + 1).alias("no"), F.concat(F.lit(" "), "c_name").alias("line"))
    heads = named.select("list", F.lit(0).cast("bigint").alias("no"), F.concat(F.lit("#"), "district").alias("line")).distinct()
    return label_headings(lines.unionByName(heads), "list", "no").select("category", "commodity")


def variant_union(spark, sf_dir):
    """The values of two variant columns as one list each."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderstatus").alias("first"), F.collect_set("o_orderpriority").alias("second"))
    return present(rows.select("o_custkey", F.sort_array(F.array_union("first", "second")).alias("variants")))


def census_names(spark, sf_dir):
    """Customers as census districts, named in the three ways that have to be mended."""
    rows = table(spark, sf_dir, "customer").join(
        F.broadcast(districts(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    name = F.concat_ws(" ", "district", key)
    raw = rows.select(
        F.lit("DISTRICT").alias("level"),
        F.when(key % 3 == 0, F.concat(F.lit("ISLES &  "), name))
        .when(key % 3 == 1, F.concat(F.lit("CITY OF "), name)).otherwise(F.lit("PUDUCHERRY")).alias("name"),
        F.concat("state", F.lit(" & COAST")).alias("state"), F.lit("Total").alias("tru"), key.cast("string").alias("area"),
        F.length("c_mktsegment").cast("string").alias("total"),
        *[F.floor(F.abs("c_acctbal")).cast("string").alias(c) for c in (
            "work", "cultivator_main", "cultivator_marginal", "agrilabourers_main", "agrilabourers_marginal", "no_work")])
    return present(clean_census(raw).select("name", "state", "area", "total", "work"))


_PLACES = """(SELECT s_suppkey, s_name AS market, n_name AS district, r_name AS state FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

QUERIES = {
    "bulletin_files": (bulletin_files, f"""WITH {OBS},
k AS (SELECT *, CAST(right(variety, 1) AS INT) % 5 AS k FROM obs)
SELECT {d('date')} AS date, state, CASE WHEN k IN (1, 3) THEN 'FAQ' END AS grade,
       CASE WHEN k IN (2, 3) THEN 'Far, State' END AS origin_state, {n('count(*)')} AS n,
       {n('count(*) FILTER (k IN (2, 3))')} AS origins, {s('sum(tonnage)')} AS tonnage,
       {s('sum(modal_price)')} AS price, {n('1')} AS readable
FROM k WHERE k < 4 GROUP BY date, state, 3, 4
UNION ALL SELECT NULL, NULL, NULL, NULL, {n('count(*)')}, NULL, NULL, NULL, 0 FROM k WHERE k = 4"""),
    "older_files": (older_files, f"""WITH {OBS},
k AS (SELECT *, CAST(right(variety, 1) AS INT) % 3 AS k FROM obs)
SELECT state, commodity || CASE WHEN k = 2 THEN ' split up' ELSE '' END AS commodity,
       CASE WHEN k = 1 THEN 'FAQ' END AS grade, {n('count(*)')} AS n,
       {s('sum(tonnage)')} AS tonnage, {s('sum(modal_price)')} AS price FROM k GROUP BY 1, 2, 3"""),
    "split_names": (split_names, """
SELECT p_partkey, p_type || ' ' || p_brand || CASE WHEN p_size > 20 THEN ' x' ELSE '' END AS commodity FROM part"""),
    "location_dictionary": (location_dictionary, f"SELECT state, district, market AS taluk FROM {_PLACES}"),
    "market_dictionary": (market_dictionary, f"""
SELECT state || '_' || market AS location_key, lower(market) AS market_cleaned, market, state, district,
       CASE WHEN s_suppkey % 3 > 0 THEN district END AS taluk FROM {_PLACES}"""),
    "selection_dictionary": (selection_dictionary, """
SELECT DISTINCT p_type AS category, p_name || ' ' || p_size AS commodity FROM part"""),
    "correction_dictionary": (correction_dictionary, """
SELECT DISTINCT p_type AS scope, upper(p_name) AS wrong, p_name AS right FROM part"""),
    "census_dictionary": (census_dictionary, f"""
SELECT 'Districts' AS level, c_name AS name, c_mktsegment AS state, 'Rural' AS tru, CAST(c_custkey AS DOUBLE) AS area,
       CAST(5 AS DOUBLE) AS total, CAST(c_custkey AS DOUBLE) AS work, CAST(NULL AS DOUBLE) AS no_work FROM customer
UNION ALL SELECT 'Districts', c_name, c_mktsegment, 'Urban', 2, 7, c_custkey, NULL FROM customer WHERE c_custkey % 2 = 0"""),
    "csv_report": (csv_report, f"""
SELECT l_returnflag, CAST(round(sum(l_quantity) / count(*), 3) AS VARCHAR) AS mean, {n('count(*)')} AS n
FROM lineitem GROUP BY l_returnflag"""),
    "excluded_record": (excluded_record, f"""
SELECT market, CASE WHEN market = 'Supplier#000000003' THEN 1 ELSE 2 END::BIGINT AS n,
       CASE WHEN market = 'Supplier#000000003' THEN 0 ELSE 1 END::BIGINT AS regulated FROM {_PLACES}"""),
    "staff": (staff, """
SELECT c_custkey, CASE WHEN c_nationkey IN (3, 4) THEN NULL ELSE CAST(c_nationkey + c_custkey AS DOUBLE) END AS staff FROM customer"""),
    "share_counts": (share_counts, f"""
SELECT o_orderpriority, {n('count(*)')} AS length, {n('count(*) FILTER (o_totalprice > 100000)')} AS count
FROM orders GROUP BY 1"""),
    "feature_file": (feature_file, f"""
SELECT 'FeatureCollection' AS type, s_suppkey AS id, CAST(s_suppkey AS DOUBLE) AS lng, market AS name, district FROM {_PLACES}"""),
    "headed_list": (headed_list, """
SELECT n_name AS category, c_name AS commodity FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "variant_union": (variant_union, """
SELECT o_custkey, string_agg(DISTINCT v, ',' ORDER BY v) AS variants
FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS v FROM orders) GROUP BY 1"""),
    "census_names": (census_names, """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'Isles and ' || upper(n_name[1]) || lower(n_name[2:6]) || '_' || n_name[8:] || ' ' || c_custkey
            WHEN 1 THEN 'City of ' || upper(n_name[1]) || lower(n_name[2:6]) || '_' || n_name[8:] || ' ' || c_custkey
            ELSE 'Pondicherry' END AS name,
       list_aggregate(list_transform(string_split(r_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || ' and Coast' AS state,
       CAST(c_custkey AS DOUBLE) AS area, CAST(length(c_mktsegment) AS DOUBLE) AS total, CAST(floor(abs(c_acctbal)) AS DOUBLE) AS work
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
}
