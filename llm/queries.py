"""The registered queries of the operators, with SQL twins where SQL can express them."""

import public_tokenizers
from pyspark.sql import functions as F

from llm import bpe, chat, collocations, jaccard, language_model, mixing, neighbours, prefix_trie, quality_classifier, quality_rules, token_counts, toxicity, transducer
from llm.common import fold_of, table

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark, sf_dir):
    """Encode and decode every text of ``documents``; digests of ids and decoded text."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                             ("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op2_jaccard(spark, sf_dir):
    """Classes of ``documents`` whose word 5-gram sets overlap by 80 of 100."""
    return jaccard.join_classes(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    """How often the mix takes each of ``documents``."""
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_neighbours(spark, sf_dir):
    """The 20 nearest of every 20th of ``embeddings``."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language_model(spark, sf_dir):
    """Model and base scores of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 5)
    kind = (F.when(fold == 1, language_model.SCORED).when(fold == 4, language_model.HELD).otherwise(language_model.COUNTED))
    scored = language_model.score(docs, kind)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_chat_format(spark, sf_dir):
    """All ``conversations`` and one that says control strings, rendered and read back."""
    control = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '' AS text UNION ALL SELECT -7L, 1L, 'assistant', ''")
    rows = given.unionByName(more.withColumn("text", F.lit(control)))
    read = chat.parse(chat.format_chats(chat.as_events(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op7_quality_rules(spark, sf_dir):
    """Base rules and the trees' verdict on every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    trees = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, trees, keep=["doc_id"])


def op8_quality_classifier(spark, sf_dir):
    """Expected grade of every text of ``documents``, and the choice by it."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, quality_classifier.grades(table(spark, sf_dir, "labels")))
    return quality_classifier.classify(docs, model, keep=["doc_id"])


def op9_token_counts(spark, sf_dir):
    """Tokens of every text of ``documents``."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_toxicity(spark, sf_dir):
    """Toxicity of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op11_byte_bpe(spark, sf_dir):
    """Encode and decode every text of ``documents`` by a file of ranks; digests of both."""
    return transducer.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                                    ("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op12_prefix_trie(spark, sf_dir):
    """The trie of the beginnings that rebuilt ``conversations`` share."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark, sf_dir):
    """The 2,000 best phrases of each language of ``documents``."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": (op1_bpe, None),
    "op2_jaccard": (op2_jaccard, jaccard.SQL),
    "op3_mixing": (op3_mixing, mixing.SQL),
    "op4_neighbours": (op4_neighbours, None),
    "op5_language_model": (op5_language_model, None),
    "op6_chat_format": (op6_chat_format, chat.SQL),
    "op7_quality_rules": (op7_quality_rules, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_token_counts": (op9_token_counts, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_byte_bpe": (op11_byte_bpe, None),
    "op12_prefix_trie": (op12_prefix_trie, prefix_trie.SQL),
    "op13_collocations": (op13_collocations, collocations.SQL),
}
