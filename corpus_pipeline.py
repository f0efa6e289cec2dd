"""The corpus pipeline: documents filtered, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

import public_tokenizers
from pyspark.sql import functions as F

from llm import bpe, jaccard, mixing, quality_rules, toxicity
from llm.common import table
from llm.queries import TOKENIZER
from mandigrid.session import materialise, shared_dir


def quality_stage(spark, docs, sf_dir):
    """Documents that pass the base rules and the trees, which learn from the labels of what is given."""
    trees = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, trees).where("kept").select(*docs.columns)


def toxicity_stage(spark, docs, sf_dir):
    """Documents that are not predicted to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def duplicates_stage(spark, docs, sf_dir):
    """Of each class of near copies the document with the smallest id; of rows with the same
    id and text, the first by the other columns. Documents without words or id stay."""
    classes = jaccard.join_classes(docs)
    gone = classes.where("n_shingles > 0 AND component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(jaccard.small(materialise(gone, "pipeline-copies")), "doc_id", "left_anti")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    kept = kept.withColumn("__text", F.xxhash64("text"))
    repeated = kept.where("doc_id IS NOT NULL").groupBy("doc_id", "__text").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    once = kept.join(repeated, ["doc_id", "__text"], "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__first"))
    once = once.select("doc_id", "text", "__first.*").select(*docs.columns)
    return kept.join(repeated, ["doc_id", "__text"], "left_anti").select(*docs.columns).unionByName(once)


def mixing_stage(spark, docs, sf_dir):
    """Documents as often as the mix takes them. A document without words is never taken."""
    mixed = mixing.mix(docs)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.where("taken > 0").withColumn("__pass", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def encoding_stage(spark, docs, sf_dir):
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER), ("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id", "source"])


STAGES = [
    ("quality rules", quality_stage), ("toxicity", toxicity_stage), ("near duplicates", duplicates_stage),
    ("mixing", mixing_stage), ("encoding", encoding_stage),
]


def run(spark, sf_dir):
    """The stages applied to ``documents``, each result written as Parquet in the shared folder
    and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: No SQL: learned models and token ids. Tests compare the stages with brute force.
ORACLE_SQL = None
