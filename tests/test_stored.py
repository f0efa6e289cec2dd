"""Stored tables follow the files they are made from."""

import shutil
import time

from conftest import SF_DIR

from mandigrid.queries import serving
from mandigrid.sources.stored import stored_table


def test_a_table_is_built_again_only_if_its_files_changed(spark, tmp_path):
    def put(name, value):
        spark.createDataFrame([(name, value)], "k string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    sources = {"fact": str(tmp_path / "fact"), "side": str(tmp_path / "side")}
    done = []

    def build(path):
        done.append("build")
        spark.read.parquet(*sources.values()).write.parquet(path)

    def grow(path, files):
        done.append(len(files))
        spark.read.parquet(*files).write.mode("append").parquet(path)

    def read(**options):
        out = stored_table(spark, str(tmp_path / "home"), sources, build, **options)
        return sorted(r.v for r in out.collect())

    put("fact", 1), put("side", 10)
    grown = {"grow": grow, "growing": ["fact"]}
    assert read(**grown) == [1, 10] and read(**grown) == [1, 10] and done == ["build"]
    put("fact", 2), put("fact", 3)
    assert read(**grown) == [1, 2, 3, 10] and done == ["build", 2]
    put("side", 20)  # another source: all is built again
    assert read(**grown) == [1, 2, 3, 10, 20] and done == ["build", 2, "build"]
    time.sleep(1.1)
    spark.createDataFrame([("fact", 9)], "k string, v int").coalesce(1).write.mode("overwrite").parquet(sources["fact"])
    assert read(**grown) == [9, 10, 20] and done[3:] == ["build"]  # files went
    assert read() == [9, 10, 20] and done[4:] == []


def test_dashboard_reads_show_appended_lines(spark, tmp_path):
    folder = tmp_path / "data"
    shutil.copytree(SF_DIR, folder)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    (folder / "lineitem.parquet").unlink()
    lines.filter("l_orderkey % 2 = 0").write.parquet(str(folder / "lineitem.parquet"))

    def fresh():
        """The series, and the roll-ups made without a stored table."""
        stored = serving.rollup_table(spark, str(folder))
        columns = ["level", "date", "commodity", "state", "district", "market", "tonnage", "contrib"]
        direct = serving._levels(spark, str(folder)).select(*columns)
        assert stored.select(*columns).exceptAll(direct).isEmpty() and direct.exceptAll(stored.select(*columns)).isEmpty()
        return serving.series_state(spark, str(folder)).agg({"contrib": "sum"}).first()[0]

    before = fresh()
    lines.filter("l_orderkey % 2 = 1").write.mode("append").parquet(str(folder / "lineitem.parquet"))
    assert fresh() > before
