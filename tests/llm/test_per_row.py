"""Functions of rows get bounded batches and give back all rows."""

import gc

import public_tokenizers
import pyarrow as pa

from llm import bpe, common


def test_functions_get_bounded_batches(spark):
    def make():
        return lambda batch: [pa.array([batch.num_rows] * batch.num_rows, pa.int64()),
                              pa.array([(t or "").upper() for t in batch.column(0).to_pylist()])]

    docs = spark.createDataFrame([(i, f"text {i}" if i % 7 else None) for i in range(2500)], "doc_id long, text string").coalesce(1)
    out = common.per_row(docs, ["text"], "rows long, upper string", make, ["doc_id"]).collect()
    assert max(r["rows"] for r in out) <= common.ROWS
    assert sorted((r["doc_id"], r["upper"]) for r in out) == [(i, f"TEXT {i}" if i % 7 else "") for i in range(2500)]
    assert common.per_row(docs.where("doc_id < 0"), ["text"], "rows long, upper string", make, ["doc_id"]).count() == 0


def test_workers_drop_what_tasks_of_others_kept(spark):
    def make():
        def function(batch):
            models = sum(isinstance(o, bpe.Pieces) for o in gc.get_objects())
            return [pa.array([models] * len(batch), pa.int64())]
        return function

    docs = spark.range(64).selectExpr("id AS doc_id", "concat('some text ', id) AS text").repartition(8)
    encoded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ["n_tokens"])
    assert len(encoded.collect()) == 64
    out = common.per_row(docs, ["text"], "models long", make, ["doc_id"]).collect()
    assert len(out) == 64 and {r["models"] for r in out} == {0}


def test_what_is_kept_serves_the_next_task():
    made = []
    make = lambda: common.kept("a", lambda: made.append(1) or made)
    assert common.begun(make) is common.begun(make) and made == [1]
    common.begun(lambda: None)
    common.begun(make)
    assert made == [1, 1]
    common.kept("b", list)
    common.begun(make)
    assert made == [1, 1, 1]


def test_listed_ids_need_no_python_workers(spark, capsys):
    for ids, kind in (([3, 1, 2**40], "bigint"), (["x", "é", None], "string"), ([], "int")):
        field = spark.createDataFrame([], f"doc_id {kind}").schema["doc_id"]
        df = common.listed(spark, ids, field)
        assert [r["doc_id"] for r in df.collect()] == ids and df.dtypes == [("doc_id", kind)]
        df.explain()
        assert "ExistingRDD" not in capsys.readouterr().out
