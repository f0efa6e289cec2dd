import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from mandigrid.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("mandigrid-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(values, schema) -> DataFrame"""
    return lambda values, schema: spark.createDataFrame(values, schema)


@pytest.fixture
def evaluate(spark):
    """Values of a Column over one-column rows of text."""
    def run(column, values, schema="x string"):
        data = [v if isinstance(v, tuple) else (v,) for v in values]
        df = spark.createDataFrame([(i, *v) for i, v in enumerate(data)], "i int, " + schema)
        return [r[0] for r in df.orderBy("i").select(column).collect()]
    return run
