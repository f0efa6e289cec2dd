import json

from pyspark.sql import functions as F

from mandigrid.fixed_values import REPORT_HEADINGS
from mandigrid.sources import bulletins, dimensions, sinks
from mandigrid.plans.reference_tables import clean_census
from mandigrid.operators.changes import changes, replay
from mandigrid.operators.reference_data import census_by_unit
from mandigrid.streaming.ingest import ROLLUP_KEY, RollupStore, append_new, ingest, refresh_rollups

LINES = [
    "04/04/2012,Kerala,Manjeri,Beverages,Coffee,Other,1.0,100,200,140",
    '04/04/2012,Kerala,"Pulpally",Beverages,Coffee,Other,,FAQ,1,2,NR',
    "04/04/2012,Kerala,Kochi,Beverages,Tea,Other,2.0,1,2,3,Kerala,Kochi",
    '05/04/2012,Orissa,"A, B",Beverages,Tea,Other,2.0,FAQ,1,2,Kerala,Kochi,3',
    "too,short",
]


def test_layout_by_width(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(LINES[:2]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(LINES[2:]) + "\n")
    df = bulletins.read_bulletins(spark, str(tmp_path))
    got = {r.market: (str(r.date), r.grade, r.tonnage, r.modal_price, r.origin_market)
           for r in df.collect()}
    assert got == {
        "Manjeri": ("2012-04-04", None, 1.0, 140.0, None),
        "Pulpally": ("2012-04-04", "FAQ", None, None, None),
        "Kochi": ("2012-04-04", None, 2.0, 3.0, "Kochi"),
        "A, B": ("2012-04-05", "FAQ", 2.0, 3.0, "Kochi")}
    odd = bulletins.unreadable_lines(spark.read.text(str(tmp_path)))
    assert [r.value for r in odd.collect()] == ["too,short"]


def test_older_layouts(rows):
    df = rows([("01/02/2003,S,M,Sesame,V,1,2,3,4",), ("01/02/2003,S,M,Sesame,V,1,FAQ,2,3,4",),
               ("01/02/2003,S,M,Sesamum(Sesame,Gingelly,Til),V,1,2,3,4",)], "value string")
    got = [(r.commodity, r.grade, r.modal_price) for r in
           bulletins.parse_lines(df, "older").collect()]
    assert got == [("Sesame", None, 4.0), ("Sesame", "FAQ", 4.0),
                   ("Sesamum(Sesame Gingelly Til)", None, 4.0)]


def test_split_names_and_headers(rows):
    df = rows([("x", "a ", " b", "c")], "k string, p string, q string, r string")
    assert bulletins.repair_split_name(df, ["p", "q", "r"]).first().commodity == "a b c"
    report = rows([("Goa", "1"), ("state", "coverage"), (None, "2")], "state string, v string")
    assert bulletins.drop_repeated_headers(report, REPORT_HEADINGS).count() == 2


def test_stack(rows):
    out = bulletins.stack([rows([(1,)], "a int"), rows([(2, "x")], "a int, b string")])
    assert sorted(map(tuple, out.collect())) == [(1, None), (2, "x")]


def test_dimension_files(spark, tmp_path):
    (tmp_path / "loc.json").write_text(json.dumps(
        {"Goa": {"North Goa": ["Bardez", "Bicholim"], "South Goa": []}}))
    got = {tuple(r) for r in dimensions.read_locations(spark, str(tmp_path / "loc.json")).collect()}
    assert got == {("Goa", "North Goa", "Bardez"), ("Goa", "North Goa", "Bicholim"),
                   ("Goa", "South Goa", None)}
    (tmp_path / "m.json").write_text(json.dumps({"Goa_Mapusa": {
        "Market_Cleaned": "Mapusa", "Market": "Mapusa", "State": "Goa", "District": "North Goa",
        "Taluk": "Bardez"}}))
    row = dimensions.read_market_locations(spark, str(tmp_path / "m.json")).first()
    assert (row.location_key, row.taluk) == ("Goa_Mapusa", "Bardez")
    (tmp_path / "sel.json").write_text(json.dumps({"Cereals": ["Rice", "Wheat"]}))
    assert dimensions.read_selection(spark, str(tmp_path / "sel.json")).count() == 2
    (tmp_path / "fix.json").write_text(json.dumps({"Bihar": {"Purnea": "Purnia"}}))
    assert tuple(dimensions.read_corrections(spark, str(tmp_path / "fix.json")).first()) == (
        "Bihar", "Purnea", "Purnia")
    (tmp_path / "census.json").write_text(json.dumps({"Districts": {"Leh": {
        "rural": {"area": 2.0, "population": {"total": 9}}, "state": "JK"}}}))
    row = dimensions.read_census(spark, str(tmp_path / "census.json")).first()
    assert (row.name, row.state, row.tru, row.area, row.total) == ("Leh", "JK", "Rural", 2.0, 9.0)


def test_census_names(rows):
    measures = ("Total Population Person", "Total Worker Population Person",
                "Main Cultivator Population Person", "Marginal Cultivator Population Person",
                "Main Agricultural Labourers Population Person",
                "Marginal Agriculture Labourers Population Person",
                "Non Working Population Person")
    schema = "level string, name string, state string, tru string, area string, " + ", ".join(
        f"`{m}` string" for m in measures)
    df = rows([("DISTRICT", "Purbi  Singhbhum", "JAMMU & KASHMIR", "Rural", "1.5", *"1234567"),
               ("DISTRICT", "Purbi  Singhbhum", "JAMMU & KASHMIR", "Total", "2", *"1234567"),
               ("STATE", "NCT OF DELHI", "NCT OF DELHI", "Total", "2", *"1234567")], schema)
    clean = clean_census(df)
    assert {(r.name, r.state) for r in clean.collect()} == {
        ("East Singhbhum", "Jammu and Kashmir"), ("NCT of Delhi", "NCT of Delhi")}
    unit = census_by_unit(clean, "DISTRICT").first()
    assert (unit.rural.area, unit.rural.population.total, unit.total.area,
            unit.urban.area) == (1.5, 1.0, 2.0, None)


def test_rollup_table_is_replaced_by_partition(spark, rows, tmp_path):
    path = str(tmp_path / "r")
    df = rows([("state", "Rice", 1), ("state", "Tea", 1)], "level string, commodity string, n int")
    sinks.write_rollup(df, path)
    sinks.write_rollup(df.filter("commodity = 'Tea'").withColumn("n", F.lit(2)), path)
    assert {(r.commodity, r.n) for r in spark.read.parquet(path).collect()} == {
        ("Rice", 1), ("Tea", 2)}


def test_csv_report(spark, rows, tmp_path):
    path = str(tmp_path / "c")
    sinks.write_csv_report(rows([(1.23456, "x")], "v double, k string"), path)
    sinks.write_csv_report(rows([(9.0, "y")], "v double, k string"), path, replace=False)
    assert [tuple(r) for r in spark.read.csv(path, header=True).collect()] == [("1.235", "x")]


def test_append_documents(spark, rows, tmp_path):
    path = str(tmp_path / "d")
    sinks.append_documents(rows([(1, "a"), (1, "a")], "k int, v string"), path, ["k"])
    sinks.append_documents(rows([(1, "b"), (2, "c")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_append_documents_with_null_keys(spark, rows, tmp_path):
    path = str(tmp_path / "d")
    df = rows([(None, "b"), (None, "a"), (1, None)], "k int, v string")
    for _ in range(2):
        sinks.append_documents(df, path, ["k"])
    assert sorted(map(repr, map(tuple, spark.read.parquet(path).collect()))) == [
        "(1, None)", "(None, 'a')"]


def test_point_features(spark, rows, tmp_path):
    markets = rows([(7, "Mapusa", "Goa", None, 73.8, 15.5)],
                   "id int, name string, state string, district string, lng double, lat double")
    sinks.write_point_features(markets, str(tmp_path / "f"))
    feature = json.loads(spark.read.text(str(tmp_path / "f")).first().value)
    assert feature["geometry"]["coordinates"] == [73.8, 15.5]
    assert feature["properties"] == {"name": "Mapusa", "state": "Goa", "district": None}


def test_stream_equals_batch(spark, tmp_path):
    """The same files give the same table, file by file or all at once, repeats apart."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.csv").write_text("\n".join(LINES[:2]) + "\n")
    (inbox / "2.csv").write_text("\n".join(LINES[1:4]) + "\n")
    locations = spark.createDataFrame([("Kerala_Kochi", "Ernakulam", "Kanayannur")],
                                      "location_key string, district string, taluk string")
    key = ["date", "state", "market", "commodity", "variety", "grade"]
    batch = ingest(bulletins.read_bulletins(spark, str(inbox)), locations).distinct()
    stream = ingest(bulletins.stream_bulletins(spark, str(inbox), files_per_batch=1), locations)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    append_new(stream, out, key, state).awaitTermination()
    columns = sorted(batch.columns)

    def content(df):
        return sorted(repr(tuple(r)) for r in df.select(columns).collect())

    assert content(spark.read.parquet(out)) == content(batch)
    # a later file is added, what is known is not
    (inbox / "3.csv").write_text(LINES[0] + "\n" + LINES[0].replace("Manjeri", "Kollam") + "\n")
    stream = ingest(bulletins.stream_bulletins(spark, str(inbox)), locations)
    append_new(stream, out, key, state).awaitTermination()
    assert spark.read.parquet(out).count() == batch.count() + 1


def test_append_new_keeps_late_rows_and_drops_repeats(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.csv").write_text(LINES[3] + "\n")
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    key = ["date", "state", "market", "commodity", "variety", "grade"]

    def run():
        rows = ingest(bulletins.stream_bulletins(spark, str(inbox), files_per_batch=1))
        append_new(rows, store, key, state).awaitTermination()
        return spark.read.parquet(store)

    assert run().count() == 1
    years_late = LINES[0].replace("2012", "2002")
    (inbox / "2.csv").write_text("\n".join([LINES[3], years_late, years_late]) + "\n")
    assert sorted(str(r.date) for r in run().collect()) == ["2002-04-04", "2012-04-05"]


def _days(spark, path, rows):
    spark.createDataFrame(rows, "day string, market string, note string").select(
        F.to_date("day").alias("date"), "market", "note").coalesce(1).write.mode("append").parquet(path)


def test_streams_with_checkpoints_of_their_own_share_a_store(spark, tmp_path):
    """Neither a new checkpoint nor a replayed batch loses or repeats a row."""
    inboxes = [str(tmp_path / n) for n in ("one", "two")]
    store, key, schema = str(tmp_path / "store"), ["date", "market"], "date date, market string, note string"
    _days(spark, inboxes[0], [("2020-01-01", "a", "x"), ("2020-01-01", "b", "x"), (None, "n", "x"), ("2020-01-02", None, "x")])
    _days(spark, inboxes[1], [("2020-01-01", "a", "y"), ("2020-01-01", "c", "y"), (None, "n", "y"), ("2020-01-02", None, "y"), ("2019-01-01", "a", "y")])
    for inbox, state in ((0, "s0"), (1, "s1"), (0, "s2")):  # s2: the first files again, from the start
        stream = spark.readStream.schema(schema).parquet(inboxes[inbox])
        append_new(stream, store, key, str(tmp_path / state)).awaitTermination()
    got = sorted(repr((str(r.date), r.market, r.note)) for r in spark.read.parquet(store).collect())
    assert got == sorted(map(repr, [
        ("2020-01-01", "a", "x"), ("2020-01-01", "b", "x"), ("None", "n", "x"), ("2020-01-02", None, "x"),
        ("2020-01-01", "c", "y"), ("2019-01-01", "a", "y")]))


def test_known_keys_are_read_by_date(spark, tmp_path):
    from mandigrid.streaming.ingest import rows_of_dates
    _days(spark, str(tmp_path / "raw"), [(f"2020-01-{d:02}", "a", "x") for d in range(1, 20)])
    path = str(tmp_path / "dated")
    spark.read.parquet(str(tmp_path / "raw")).write.partitionBy("date").parquet(path)
    _days(spark, str(tmp_path / "arrived"), [("2020-01-03", "a", "x")])
    dates = spark.read.parquet(str(tmp_path / "arrived")).select("date").distinct()
    out = rows_of_dates(spark.read.parquet(path), dates)
    assert out.count() == 1
    assert "dynamicpruning" in out._jdf.queryExecution().toString().lower()


def test_refresh_survives_a_new_checkpoint(spark, tmp_path):
    schema = ("date date, state string, district string, market string, category string,"
              " commodity string, variety string, modal_price double, tonnage double")
    for name, tons in (("one", 1.0), ("two", 3.0)):
        df = spark.createDataFrame([("2015-04-01", "S", "D", name, "c", "Rice", "v", 10.0, tons)],
                                   schema.replace("date date", "date string")).withColumn("date", F.to_date("date"))
        df.write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        refresh_rollups(stream, str(tmp_path / "store"), str(tmp_path / f"state-{name}")).awaitTermination()
    assert {r.tonnage for r in RollupStore(spark, str(tmp_path / "store")).rollups().collect()} == {4.0}


def test_refreshed_rollups_equal_those_of_one_batch(spark, tmp_path):
    """Rows of one month that arrive in two files end in one roll-up row."""
    schema = ("date date, state string, district string, market string, category string,"
              " commodity string, variety string, modal_price double, tonnage double")
    files = [[("2015-04-01", "S", "D", "M", "c", "Rice", "v", 10.0, 1.0),
              ("2015-05-01", "S", "D", "M", "c", "Rice", "v", 30.0, 1.0)],
             [("2015-04-01", "S", "D", "N", "c", "Rice", "v", 20.0, 3.0)]]
    inbox, store = str(tmp_path / "in"), RollupStore(spark, str(tmp_path / "store"))
    for rows in files:
        df = spark.createDataFrame(rows, schema.replace("date date", "date string"))
        (df.withColumn("date", F.to_date("date")).coalesce(1).write.mode("append")
         .parquet(inbox))
        stream = spark.readStream.schema(schema).parquet(inbox)
        refresh_rollups(stream, store.path, str(tmp_path / "state")).awaitTermination()
    got = {(r.level, str(r.date)): (r.price, r.tonnage, r.contrib) for r in store.rollups().collect()}
    april, may = (17.5, 4.0, 2), (30.0, 1.0, 1)
    assert got == {(level, day): value for level in ("district", "state", "india")
                   for day, value in (("2015-04-01", april), ("2015-05-01", may))}


BULLETINS = ("date date, state string, district string, market string, category string,"
             " commodity string, variety string, modal_price double, tonnage double")


def bulletin(spark, *rows):
    """Rows (date, market, price, tonnage)"""
    df = spark.createDataFrame([(day, "S", "D", market, "c", "Rice", "v", price, tonnage) for day, market, price, tonnage in rows],
                               BULLETINS.replace("date date", "date string"))
    return df.withColumn("date", F.to_date("date"))


def test_batches_are_merged_once(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "store"))
    april, may = "2015-04-01", "2015-05-01"
    store.add(bulletin(spark, (april, "M", 10.0, 1.0), (may, "M", 30.0, 1.0), (None, "M", 1.0, 5.0)), "a", 0)
    first = {tuple(r) for r in store.rollups().select(*ROLLUP_KEY, "price", "contrib").collect()}
    late = bulletin(spark, (april, "M", 20.0, 3.0), (april, "N", 5.0, 1.0))

    def state():
        rows = store.rollups().filter("level = 'state'").collect()
        return {str(r.date): (r.price, r.tonnage, r.contrib) for r in rows}

    want = {april: ((15 * 3 + 5 * 1) / 4, 4.0, 2), may: (30.0, 1.0, 1), "None": (1.0, 5.0, 1)}
    for _ in range(2):  # the second time it is a replay
        store.add(late, "b", 1)
        assert state() == want
    feed = [(r.change, str(r.date), r.number) for r in store.feed().filter("level = 'india'").collect()]
    assert sorted(feed) == [("added", april, 0), ("added", may, 0), ("added", "None", 0), ("changed", april, 1)]
    store.merge("all")
    store.add(late, "b", 1)  # what a merge covers adds nothing any more
    assert state() == want and len(first) == 9
    store.add(bulletin(spark, (april, "M", 30.0, 1.0)), "c", 2)
    store.merge("more")
    store.add(bulletin(spark, (may, "M", 10.0, 9.0)), "d", 3)
    assert state() == {april: ((20 * 3 + 5 * 1) / 4, 4.0, 2), may: (20.0, 9.0, 1), "None": (1.0, 5.0, 1)}


def test_a_feed_leads_from_one_version_to_the_next(spark, rows):
    schema = "k string, j int, v double, w string"
    old = rows([("a", 1, 1.0, "x"), ("b", None, 2.0, None), (None, 2, 3.0, "y"), ("gone", 1, 1.0, "z"), ("same", 1, None, None)], schema)
    new = rows([("a", 1, 1.0, "y"), ("b", None, None, None), (None, 2, 3.0, "y"), ("new", 1, 1.0, "z"), ("same", 1, None, None)], schema)
    feed = changes(old, new, ["k", "j"])
    assert {(r.change, r.k, r.j) for r in feed.collect()} == {
        ("changed", "a", 1), ("changed", "b", None), ("removed", "gone", 1), ("added", "new", 1)}
    assert changes(old, old, ["k", "j"]).isEmpty()
    back = changes(new, old, ["k", "j"])
    both = feed.withColumn("n", F.lit(1)).unionByName(back.withColumn("n", F.lit(2)))
    for version, part in ((new, both.filter("n = 1")), (old, both)):
        got = replay(old, part, ["k", "j"], "n")
        assert got.exceptAll(version).isEmpty() and version.exceptAll(got).isEmpty()
