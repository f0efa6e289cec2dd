"""Run registered queries on Spark and their SQL twins on DuckDB, and compare.

    python tools/compare.py /root/testdata/sf0.01 [query or module name ...]
"""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from mandigrid.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """(problem or None, rows, Spark seconds)"""
    started = time.time()
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    seconds = time.time() - started
    if sql is None:
        return None, sum(got.values()), seconds
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}", 0, seconds
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    kinds = {c: t for c, t in df.dtypes}
    theirs = {c[0]: str(c[1]) for c in result.description}
    wide = [c for c in columns if theirs[c] == "HUGEINT" or theirs[c].startswith("DECIMAL")]
    if wide:
        return f"SQL types {[(c, theirs[c], kinds[c]) for c in wide]}", 0, seconds
    if got != expected:
        extra, lost = got - expected, expected - got
        return (f"{sum(extra.values())} rows only in Spark {list(extra)[:2]}, "
                f"{sum(lost.values())} only in SQL {list(lost)[:2]}"), sum(got.values()), seconds
    return None, sum(got.values()), seconds


def main(sf_dir, *wanted):
    from mandigrid.queries import MODULES, all_queries, all_sql
    for module in MODULES:
        if module.__name__.split(".")[-1] in wanted:
            wanted = (*wanted, *module.QUERIES)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), all_sql(), 0
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        try:
            problem, rows, seconds = compare(spark, con, sf_dir, query, sqls.get(name))
        except Exception as error:  # report and go on
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:900]}", 0, 0
        bad += problem is not None
        mark = "ok" if problem is None else "FAIL"
        print(f"{mark:4} {name:32} {rows:8} rows {seconds:6.2f}s"
              f"{'' if sqls.get(name) else '  (no SQL)'} {problem or ''}", flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
