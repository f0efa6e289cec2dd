from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from mandigrid.operators import catalogue, locate, quality, relational, rollup, timeseries as ts
from mandigrid.operators import reference_data as ref
from mandigrid.plans import bulletins, serving, statistics
from mandigrid.sources.standins import observations
from conftest import SF_DIR

MARKET_ROW = ("date date, state string, district string, market string, commodity string,"
              " category string, price double, tonnage double")


def d(text):
    return date.fromisoformat(text)


def _markets(rows, *pairs):
    return rows([(d("2015-04-01"), "S", "D", f"M{i}", "Rice", "Cereals", p, t)
                 for i, (p, t) in enumerate(pairs)], MARKET_ROW)


def test_rows_without_tonnage_do_not_count(rows):
    df = _markets(rows, (1.0, None), (1.0, 0.0), (1.0, float("nan")), (None, 5.0))
    (row,) = rollup.rollup_level(df, "district").collect()
    assert (row.price, row.tonnage, row.contrib) == (None, 5.0, 1)


@pytest.mark.parametrize("mode, price", [("exclude", 17.5), ("dilute", 7.0)])
def test_missing_price_modes(rows, mode, price):
    df = _markets(rows, (10.0, 1.0), (20.0, 3.0), (None, 6.0))
    (row,) = rollup.rollup_level(df, "state", mode).collect()
    assert (row.price, row.tonnage, row.districts) == (price, 10.0, ["D"])


def test_unknown_mode_is_refused(rows):
    with pytest.raises(ValueError):
        rollup.rollup_level(_markets(rows, (1.0, 1.0)), "state", "other")


def test_market_names(rows):
    df = _markets(rows, (10.0, 1.0), (20.0, 3.0), (None, 0.0))
    assert sorted(r.market for r in rollup.contributors(df, "state").collect()) == ["M0", "M1"]


def test_rollups_conserve_tonnage_and_count(spark):
    obs = observations(spark, SF_DIR)
    markets = rollup.rollup_varieties(obs)
    total = markets.filter("tonnage > 0").agg(F.sum("tonnage"), F.count("*")).first()
    by_level = {r.level: (r.t, r.n) for r in rollup.rollup_all_levels(markets).groupBy("level").agg(
        F.sum("tonnage").alias("t"), F.sum("contrib").alias("n")).collect()}
    assert by_level == {level: tuple(total) for level in ("district", "state", "india")}
    one = rollup.rollup_level(markets, "state").drop("districts")
    all_levels = rollup.rollup_all_levels(markets).filter("level = 'state'").select(one.columns)
    assert {tuple(r)[:2] for r in one.collect()} == {tuple(r)[:2] for r in all_levels.collect()}


def test_weighted_price_lies_between_the_market_prices(spark):
    markets = rollup.rollup_varieties(observations(spark, SF_DIR))
    bounds = markets.filter("tonnage > 0").groupBy("date", "state", "commodity").agg(
        F.min("price").alias("low"), F.max("price").alias("high"))
    outside = rollup.rollup_level(markets, "state").join(
        bounds, ["date", "state", "commodity"]).filter(
        (F.col("price") < F.col("low") - 1e-6) | (F.col("price") > F.col("high") + 1e-6))
    assert outside.isEmpty()


def test_union_of_variety_arrays(rows):
    df = rows([("S", "D", "M", "c", "x", ["b", "a"]), ("S", "D", "M", "c", "x", ["a"]),
               ("S", "D", "N", "c", "x", ["z"])],
              "state string, district string, market string, category string, commodity string,"
              " varieties array<string>")
    assert catalogue.unit_varieties(df, "state").first().varieties == ["a", "b", "z"]
    got = {r.market: (r.varieties, r.records) for r in catalogue.market_commodities(df).collect()}
    assert got == {"M": (["a", "b"], 2), "N": (["z"], 1)}


def test_coverage_of_own_range(rows):
    df = rows([("Rice", d(f"2015-04-{day:02}")) for day in (1, 2, 2, 15)],
              "commodity string, date date")
    assert quality.coverage(df, ["commodity"]).first().coverage == 10.0
    fixed = quality.coverage(df, ["commodity"], "2015-04-02", "2015-04-05").first()
    assert fixed.coverage == 25.0


def test_thresholds_are_strict(rows):
    df = rows([(0, 0, 0), (50, 100, 0), (50, 99, 0)],
              "coverage int, missing_prices int, missing_tonnages int")
    assert [tuple(r) for r in relational.within_thresholds(df).collect()] == [(50, 99, 0)]


def test_statistics_of_an_empty_range(rows):
    df = _markets(rows, (1.0, 1.0)).withColumn("contrib", F.lit(1))
    assert quality.unit_statistics(df, "state", "2015-04-01", "2015-04-01").isEmpty()


def test_interpolation(rows):
    values = [("2015-12-31", None), ("2016-01-01", 10.0), ("2016-01-02", None),
              ("2016-01-05", 18.0), ("2016-01-06", None)]
    df = rows([(k, d(t), v) for k in ("a", "b") for t, v in values], "k string, date date, v double")
    out = ts.interpolate(df, ["k"], "v").orderBy("k", "date").collect()
    assert [r.v for r in out] == [None, 10.0, 12.0, 18.0, 18.0] * 2


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_forward_fill_across_chunks(rows, chunk):
    values = ["a", None, None, "b", None]
    df = rows([(g, i, v) for g in ("f", None) for i, v in enumerate(values)],
              "g string, n int, v string")
    out = ts.forward_fill(df, "g", "n", "v", chunk).orderBy("g", "n").collect()
    assert [r.v for r in out] == ["a", "a", "a", "b", "b"] * 2
    leading = rows([("f", 0, None), ("f", 1, "x")], "g string, n int, v string")
    assert [r.v for r in ts.forward_fill(leading, "g", "n", "v", chunk).orderBy("n").collect()] == [
        None, "x"]


def test_heading_lines(rows):
    df = rows([(1, i, x) for i, x in enumerate(["#Beverages", "Tea", "Coffee", "#Cereals", "Rice"])],
              "file int, n int, line string")
    got = [(r.category, r.commodity) for r in ts.label_headings(df, "file", "n").orderBy("n")
           .collect()]
    assert got == [("Beverages", "Tea"), ("Beverages", "Coffee"), ("Cereals", "Rice")]


def test_fill_dates_keeps_all_rows(rows):
    df = rows([("M", "Rice", "v", "S", d("2015-01-02"), 1.0),
               ("M", "Rice", "v", None, d("2015-01-02"), 2.0),
               ("M", "Rice", "v", "S", d("2014-01-01"), 3.0)],
              "market string, commodity string, variety string, state string, date date,"
              " modal_price double")
    out = ts.fill_dates(df, "2015-01-01", "2015-01-03").orderBy("date", "modal_price").collect()
    assert [(str(r.date), r.modal_price, r.state) for r in out] == [
        ("2014-01-01", 3.0, "S"), ("2015-01-01", None, "S"), ("2015-01-02", 1.0, "S"),
        ("2015-01-02", 2.0, "S"), ("2015-01-03", None, "S")]


def test_filled_series_has_one_row_per_day(spark):
    start, end = date(2024, 1, 1), date(2024, 1, 30)
    obs = observations(spark, SF_DIR)
    daily = ts.daily_series(obs.withColumn("date", F.lit(start)), ["market", "commodity"],
                            "modal_price")
    filled = ts.fill_dates(daily, start, end, ["market", "commodity"])
    keys = daily.select("market", "commodity").distinct().count()
    assert filled.count() == keys * ((end - start) / timedelta(days=1) + 1)


def test_keep_last_and_first(rows):
    df = rows([("k", 1, "a"), ("k", 2, "b"), ("j", 5, None)], "key string, n int, v string")
    assert {r.key: r.v for r in relational.keep_last(df, "key", "n").collect()} == {
        "k": "b", "j": None}
    assert {r.key: r.v for r in relational.keep_one(df, "key").collect()} == {"k": "a", "j": None}


def test_find_variants(rows):
    df = rows([(i, i % 2) for i in range(10)], "n int, odd int")
    assert [r.n for r in relational.find_sorted(df, "n", False, odd=1).collect()] == [9, 7, 5, 3, 1]
    assert [r.n for r in relational.find_sorted_limited(df, "n", 2).collect()] == [0, 1]
    assert [r.n for r in relational.find_slice(df, "n", 3, 5).collect()] == [3, 4]


def test_other_variety(rows):
    df = rows([("Rice", "Rice"), ("Rice", "Other"), ("Tea", "Other"), ("Oats", "Oats"),
               ("Oats", "Other"), ("Oats", "x")], "commodity string, variety string")
    got = sorted(tuple(r) for r in bulletins.merge_other_variety(df).collect())
    assert got == [("Oats", "Oats"), ("Oats", "Other"), ("Oats", "x"), ("Rice", "Rice"),
                   ("Rice", "Rice"), ("Tea", "Other")]


def test_raw_bulletin(rows):
    cells = [["Kerala"], ["Market", "t", "o", "v", "a", "b", "c"],
             ["Manjeri", "1.0", "Goa_Mapusa", "Fine", "100", "200", "150"],
             ["", "", "Kerala", "Coarse", "NR", "", "1,50"],
             ["short"], ["Pulpally", "2", "X", "y", "FAQ", "100", "200", "985.5"]]
    df = rows([("p", i, "04/04/2012", "Beverages", "Coffee", c) for i, c in enumerate(cells)],
              "page string, row_no int, date string, category string, commodity string,"
              " cells array<string>")
    out = bulletins.normalise_raw_bulletin(df).orderBy("row_no").collect()
    got = [(r.state, r.market, r.tonnage, r.min_price, r.max_price, r.modal_price,
            r.origin_state, r.origin_market, r.grade) for r in out]
    assert got == [
        ("Kerala", "Manjeri", 1.0, 1.0, 2.0, 1.5, "Goa", "Mapusa", None),
        ("Kerala", "Manjeri", 1.0, None, 2.0, None, "Kerala", "Kerala", None),
        ("short", "Pulpally", 2.0, 1.0, 2.0, 9.855, "X", "X", "FAQ")]
    assert str(out[0].date) == "2012-04-04"


def test_census_split(rows):
    zero = (0.0,) * 6
    df = rows([
        ("STATE", "P", "P", "Total", None, 100.0, *zero), ("STATE", "P", "P", "Rural", 7.0, 60.0,
                                                           *zero),
        ("STATE", "P", "P", "Urban", 3.0, 40.0, *zero), ("STATE", "Q", "Q", "Total", None, 9.0,
                                                         *zero),
        ("DISTRICT", "a", "P", "Total", 1.0, 30.0, *zero),
        ("DISTRICT", "b", "P", "Total", 2.0, 20.0, *zero),
        ("DISTRICT", "c", "P", "Total", 5.0, 50.0, *zero)],
        "level string, name string, state string, tru string, area double, total double,"
        " work double, cultivator_main double, cultivator_marginal double,"
        " agrilabourers_main double, agrilabourers_marginal double, no_work double")
    out = {(r.level, r.name, r.tru): r for r in ref.split_census(df, "P", "N", ["a", "b"])
           .collect()}
    parent, new = out["STATE", "P", "Total"], out["STATE", "N", "Total"]
    assert (parent.total, parent.area, parent.work) == (50.0, 10.0 - 3.0, None)
    assert (new.total, new.area) == (50.0, 3.0)
    assert out["STATE", "Q", "Total"].total == 9.0
    assert (out["DISTRICT", "a", "Total"].state, out["DISTRICT", "c", "Total"].state) == ("N", "P")


def test_statistics_read_the_table_once(spark, tmp_path):
    obs = observations(spark, SF_DIR)
    reports = statistics.compute_statistics(obs, "1996-01-01", "2000-01-01", str(tmp_path / "s"))
    assert len(reports) == 24
    direct = quality.missing_by(obs, ["state"], ["year"])
    got = reports["nas_by_state_year"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, direct.collect()))
    combined = statistics.combine_statistics(reports)["nas_by_state_year"]
    totals = combined.filter("scope = 'total'").agg(F.sum("modal_len")).first()[0]
    assert totals == obs.count()
    scans = got._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in scans


def test_coverage_is_a_percentage(spark):
    obs = observations(spark, SF_DIR)
    months = quality.months_of_days(quality.market_days(obs), ["state", "district", "market"])
    for report in quality.coverage_reports(months, "1995-01-01", "2001-12-31").values():
        assert report.filter("coverage < 0 OR coverage > 100").isEmpty()


def test_coverage_by_bitmaps_counts_distinct_days(rows):
    days = ["2015-01-31", "2015-01-31", "2015-02-01", "2015-02-28", "2015-04-30", None, "2014-12-31"]
    obs = rows([("a", d) for d in days] + [("b", "2015-02-10"), ("n", None)], "k string, d string").selectExpr("k", "CAST(d AS DATE) AS date")

    def of(keys, *dates):
        return {tuple(r)[:-1]: round(r.coverage * 1000) for r in quality.coverage(obs, keys, *dates).collect()}

    span = (31 + 31 + 28 + 31 + 30)
    assert of(["k"]) == {("a",): round(5e5 / span), ("b",): round(1e5 / 28)}
    assert of(["k"], "2015-01-31", "2015-02-27") == {("a",): round(2e5 / 28), ("b",): round(1e5 / 28)}
    assert of(["k"], "2015-02-10", "2015-02-10") == {("a",): 0, ("b",): 100000}
    assert of(["k"], "2015-02-01", "2015-02-28")["a",] == round(2e5 / 28)
    assert of([], "2014-12-01", "2015-05-31") == {(): round(6e5 / 182)}
    assert of(["k", "year"])["a", 2014] == round(1e5 / 31)
    assert of(["k", "month"])["a", 2] == round(2e5 / 28)


def test_default_quality_map_is_the_catalogue(rows):
    cat = rows([("S", [("Cereals", "Rice", 3, 9, ["a"])]), ("T", [("Cereals", "Oats", 1, 1, ["b"])])],
               "state string, commodities array<struct<category:string, commodity:string,"
               " records_coverage:long, records_total:long, varieties:array<string>>>")
    out = serving.quality_map(None, cat, "state", "Rice", "2015-01-01", "2015-02-01").collect()
    assert [(r.state, r.records_total) for r in out] == [("S", 9)]
    left = serving.variety_options(cat, "state", "S", "Rice", ["a"])
    assert left.isEmpty()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows are of one market, commodity, variety and day."""
    obs = observations(spark, SF_DIR)
    first = obs.filter("modal_price IS NOT NULL AND tonnage IS NOT NULL").orderBy(
        "date", "market", "commodity", "variety", "modal_price").limit(1)
    return obs, obs.unionByName(first.withColumn("_i", F.explode(F.sequence(
        F.lit(1), F.lit(3000)))).drop("_i")), first.first()


def test_hot_key_changes_only_its_own_groups(skewed):
    plain, hot, row = skewed
    key = ["date", "state", "district", "market", "commodity"]

    def groups(df):
        out = rollup.rollup_varieties(df).select(*key, F.round("price", 6), "tonnage", "varieties")
        return {tuple(r[:5]): tuple(r[5:]) for r in out.collect()}

    a, b = groups(plain), groups(hot)
    changed = {k for k in a if a[k] != b[k]}
    assert a.keys() == b.keys() and changed <= {tuple(row[c] for c in key)}
    days = quality.market_days(hot)
    assert days.agg(F.sum("modal_len")).first()[0] == hot.count()
    assert days.count() == quality.market_days(plain).count()
    filled = ts.fill_dates(hot, "1998-01-01", "1998-01-03")
    assert filled.filter("modal_price IS NOT NULL").count() == hot.filter(
        "modal_price IS NOT NULL").count()
    assert relational.keep_one(hot, key).count() == len(a)


def test_interpolation_of_one_long_series_is_linear(spark):
    """The frame of the next value grows with the rows instead of being computed for each."""
    days = spark.range(40_000).select(F.lit("m").alias("market"), F.expr("date_add(date'1900-01-01', cast(id as int))").alias("date"),
                                      F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("price"))
    out = ts.interpolate(days, ["market"], "price")
    assert "UNBOUNDED FOLLOWING" not in out._jdf.queryExecution().optimizedPlan().toString().upper()
    ends = out.agg(F.min("price"), F.max("price"), F.sum("price")).first()
    assert tuple(ends)[:2] == (0.0, 39_000.0)
    assert ends[2] == pytest.approx(39_000 * 39_001 / 2 + 999 * 39_000)


def test_both_location_forms_agree_on_repeated_keys(rows):
    obs = rows([("S", "M"), ("S", "N (East)"), ("S", "none")], "state string, market string")
    known = rows([("S_M", "b", "t"), ("S_M", "a", None), ("S_N ", "c", "u"), ("S_N ", "c", "t")],
                 "location_key string, district string, taluk string")
    got = [sorted(map(repr, (tuple(r) for r in form(obs, known).select("market", "district", "taluk").collect())))
           for form in (locate.add_location, locate.add_location_rowwise)]
    assert got[0] == got[1] and len(got[0]) == 3
