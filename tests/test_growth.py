"""Steps that must not grow faster than their tables."""

from conftest import SF_DIR

from mandigrid.functions.text import strip
from mandigrid.operators import catalogue, matching, rollup
from mandigrid.plans import bulletins
from mandigrid.queries import serving
from mandigrid.queries.rollups import market_rows
from mandigrid.streaming import ingest
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spellings_pass_the_driver_in_no_broadcast(spark):
    words = spark.createDataFrame([("en", w) for w in ("wheat", "wheat", "wheet", "rice", None)], "lang string, word string")
    found = matching.canonical_spelling(words, "word", ["lang"], 1)
    assert "Broadcast" not in _plan(found)
    assert sorted((r.word, r.canonical) for r in found.collect()) == [
        ("rice", "rice"), ("wheat", "wheat"), ("wheet", "wheat")]


def test_market_rows_are_shuffled_once(spark):
    obs = spark.range(4).selectExpr(
        "DATE'2020-01-01' AS date", "'s' AS state", "'d' AS district", "'m' AS market", "'c' AS commodity",
        "'k' AS category", "CAST(id % 3 AS STRING) AS variety", "CAST(id AS DOUBLE) AS modal_price", "CAST(id AS DOUBLE) AS tonnage")
    rows = rollup.rollup_varieties(obs)
    assert _plan(rows).count("Exchange ") == 1
    one = rows.first()
    assert (one.price, one.tonnage, one.varieties) == (1.5, 3.0, ["0", "1", "2"])


def test_catalogues_share_the_stored_market_rows(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("made again")

    monkeypatch.setattr(catalogue, "materialise", never)
    monkeypatch.setattr(serving, "shared_base", lambda spark: str(tmp_path))
    assert serving.hierarchy_options(spark, SF_DIR).count() == serving.hierarchy_options(spark, SF_DIR).count()
    kept, direct = serving._stored_markets(spark, SF_DIR), market_rows(spark, SF_DIR)
    keys = [c for c in direct.columns if c != "price"]
    assert kept.columns == direct.columns and kept.count() == direct.count()
    assert kept.select(keys).exceptAll(direct.select(keys)).isEmpty()


def test_merges_are_written_once(spark, tmp_path, monkeypatch):
    purposes = []
    plain = ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, purpose: purposes.append(purpose) or plain(df, purpose))
    store = ingest.RollupStore(spark, str(tmp_path / "store"))

    def batch(price):
        return spark.createDataFrame([("s", "d", "m", "c", "k", "v", price, 2.0)], "state string, district string,"
                                     " market string, commodity string, category string, variety string,"
                                     " modal_price double, tonnage double").withColumn("date", F.lit("2020-01-01").cast("date"))

    store.add(batch(1.0), "a", 0), store.add(batch(3.0), "b", 1), store.merge("ab"), store.merge("ab")
    assert "merged-partials" not in purposes
    store.add(batch(5.0), "c", 2)
    assert {r.price for r in store.rollups().collect()} == {3.0}


def test_market_names_are_cleaned_once_each(spark, monkeypatch):
    purposes = []
    plain = bulletins.materialise
    monkeypatch.setattr(bulletins, "materialise", lambda df, purpose: purposes.append(purpose) or plain(df, purpose))
    clean = spark.createDataFrame([("S", "M Mkt.", 1.0), ("S", "M", 2.0), (None, "N Yard", 0.0), ("S", None, 4.0)],
                                  "state string, market string, tonnage double")
    places = spark.createDataFrame([("S_M", "d", "t")], "location_key string, district string, taluk string")
    out = bulletins.integrate_bulletins(clean, places)
    assert purposes == ["market-names"]
    assert sorted((str(r.state), str(r.market), str(r.district), str(r.tonnage)) for r in out.collect()) == [
        ("None", "N", "None", "None"), ("S", "M", "d", "1.0"), ("S", "M", "d", "2.0"), ("S", "None", "None", "4.0")]


def test_strip_is_that_of_its_pattern(spark):
    texts = [a + m + b for a in ("", " ", "\t\n", "\u2028", "\u00a0") for m in ("", "x", "x y")
             for b in ("", " ", " \n", "\r\n", " \u2028", "\u0085", " \n\u2029", "\u00a0")] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = F.trim(F.regexp_replace("t", r"^\s+|\s+$", ""))
    assert rows.filter(~strip("t").eqNullSafe(slow)).isEmpty()
