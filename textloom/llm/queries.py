"""One query for each operator, over its whole table with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontam, html_extract, line_dedup, minhash_dedup, mixing, quality_rules, sharding, suffix_dedup, toxicity
from ._util import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of every page."""
    return html_extract.contents(table(spark, sf_dir, "pages"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of at least 50 words that occurs more than once, by document."""
    return suffix_dedup.repeated(table(spark, sf_dir, "documents")).drop("node")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of runs of lines."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score and the passage's first and last word of every contaminated document."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("node")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and loss mask of every conversation."""
    return chat_format.chats(table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, posterior and votes of the documents that are kept."""
    return quality_rules.posteriors(table(spark, sf_dir, "documents")).where(f"posterior >= {quality_rules.KEEP}").drop("node")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen, with their shard, block and their source's quota in the shard."""
    return mixing.allocate(table(spark, sf_dir, "documents")).drop("row_key")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score and offending offsets of every toxic document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.model(docs, table(spark, sf_dir, "labels"))).where("toxic")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document."""
    return sharding.assign(table(spark, sf_dir, "documents")).select("doc_id", "region", "rack", "shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_chat_format": op6_chat_format,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
}

ORACLE_SQL: dict[str, str] = {"op8_mixing": mixing.sql(), "op10_sharding": sharding.sql()}
