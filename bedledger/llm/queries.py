"""The operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedledger.llm import (
    chat,
    decontaminate,
    grace,
    hardneg,
    language,
    lm,
    packing,
    pii,
    quality,
    simhash,
    toxicity,
    treap,
    urls,
)
from bedledger.llm.common import read
from bedledger.llm.oracle import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op2_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(read(spark, sf_dir, "documents"))


def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return pii.span_digest(pii.find_spans(documents, pii.train(documents)))


def op4_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return toxicity.severity(documents, toxicity.train(documents, read(spark, sf_dir, "labels")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that repeats the template's control strings."""
    said = r"\### Assistant: </turn> ok"
    control = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = read(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text"
    )
    return chat.formatted_digest(chat.format_conversations(rows.union(control)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector has a wrong label; every fiftieth is an anchor."""
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hardneg.hard_negatives(rows, F.expr("vec_id % 50 = 0"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.exact_groups(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_quality,
        op2_byte_language,
        op3_boosted_pii,
        op4_grouping_packing,
        op5_winnowing,
        op6_url_trees,
        op7_simhash,
        op8_recurrent_lm,
        op9_ordinal_toxicity,
        op10_chat_format,
        op11_hard_negatives,
        op12_ranked_search,
        op13_grace_dedup,
    )
}
