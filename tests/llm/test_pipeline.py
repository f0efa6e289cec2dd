"""The pipeline's stages against brute force on the smallest tables."""

from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from llm import mixing, toxicity
from llm.common import table

from test_jaccard import classes_by_hand
from test_quality import base_by_hand

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF_DIR, "documents")
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        held[name] = (given, docs)
        if name != "encoding":
            assert docs.columns == given.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())

    given, out = held["quality rules"]
    counts = {r["doc_id"]: base_by_hand(r["text"]) for r in given.collect()}
    fine = {i for i, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    bad = {r["doc_id"] for r in table(spark, SF_DIR, "labels").where("quality = 0").collect()}
    assert set(ids(out)) <= fine and not set(ids(out)) & bad and len(ids(out)) > 0.8 * len(fine - bad)

    given, out = held["toxicity"]
    model = toxicity.fit(given, table(spark, SF_DIR, "labels"))
    assert ids(out) == sorted(r["doc_id"] for r in toxicity.score(given, model).where("score < 0.3").collect())

    given, out = held["near duplicates"]
    rows = [(r["doc_id"], r["text"]) for r in given.collect()]
    assert ids(out) == sorted(set(classes_by_hand(rows).values()))

    given, out = held["mixing"]
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(given).collect()}
    assert ids(out) == sorted(i for i, n in times.items() for _ in range(n))

    given, out = held["encoding"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids)) for r in given.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out.collect()) == want


def test_repeated_ids_stay_once(spark):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 2 + [(2, "g h", "en", "s", 1), (3, "a b c d e f", "en", "s", 1), (None, "x", "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.duplicates_stage(spark, docs, SF_DIR).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 1, 2, 4]


def test_of_repeated_texts_the_first_stays(spark):
    rows = [(1, "a b c", "en", "z", 1), (1, "a b c", "de", "y", 1), (1, "another text", "en", "z", 1), (2, None, "b", "s", 1), (2, None, "a", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.duplicates_stage(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[1], rows[2], rows[4]]))
