"""Writers that append to one table at the same time."""

from threading import Thread

from pyspark.sql import functions as F

from mandigrid.sources.commits import CommittedTable, append_shared

DDL = "date date, k string, v string"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, DDL.replace("date date", "date string")).withColumn("date", F.to_date("date"))


def test_two_interleaved_writers_leave_one_row_a_key(spark, tmp_path):
    first = rows_of(spark, [("2020-01-01", "a", "1"), ("2020-01-01", "b", "1"), (None, "n", "1")])
    second = rows_of(spark, [("2020-01-01", "a", "2"), ("2020-01-02", "c", "2"), (None, "n", "2"), (None, None, "2")])
    table = CommittedTable(spark, str(tmp_path / "t"), first.schema)

    def other():  # commits after the first writer has read the table
        assert CommittedTable(spark, table.path, first.schema).append(second, ["date", "k"], "two") == 1

    assert table.read().isEmpty()
    assert table.append(first, ["date", "k"], "one", other) == 2
    want = [("a", "2"), ("b", "1"), ("c", "2"), ("n", "2"), (None, "2")]
    read = lambda: sorted(((r.k, r.v) for r in table.read().collect()), key=str)
    assert read() == sorted(want, key=str)
    assert table.append(first, ["date", "k"], "one") == 2 and read() == sorted(want, key=str)  # a replay


def test_streams_at_the_same_time(spark, tmp_path):
    inbox = str(tmp_path / "in")
    rows_of(spark, [(f"2020-01-{1 + i % 3:02}", f"k{i}", "x") for i in range(40)]).repartition(4).write.parquet(inbox)
    problems = []

    def run(name):
        try:
            stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 2).parquet(inbox)
            append_shared(stream, str(tmp_path / "t"), ["date", "k"], str(tmp_path / name)).awaitTermination()
        except Exception as error:
            problems.append(error)

    writers = [Thread(target=run, args=(f"c{i}",)) for i in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not problems
    out = CommittedTable(spark, str(tmp_path / "t"), spark.read.parquet(inbox).schema).read()
    assert out.count() == 40 == out.select("k").distinct().count()
