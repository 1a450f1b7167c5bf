"""The corpus pipeline: documents in, clean, distinct, mixed and placed documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents.

Defined results, of each stage and of the whole: a null or empty text is kept by the first three stages (it is not toxic, no copy and holds no
benchmark item) and has no tokens in mixing, where it goes with its block; a null doc_id is a value like others, and a null source a source
of its own; of repeated rows, which are copies of each other, one stays (rows without words are no copies and all stay); of tied copies the smallest doc_id stays,
null last; very long texts are read whole; an empty table gives no rows; extra columns, whatever their names, are carried
along, but region, rack and shard are replaced by the last stage's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontam, minhash_dedup, mixing, sharding, toxicity
from textloom.llm._util import delete, discard_all, shared_dir, table, until_exit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the span tagger, fitted to labelled documents of the input, calls toxic."""
    return toxicity.drop_toxic(docs, toxicity.model(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return minhash_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a copy, exact or edited, of a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of each source that its target weight gives it."""
    return mixing.mix_documents(docs)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its region, rack and shard."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place),
]

#: Neither the tagger nor the groups can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, table(spark, sf_dir, "documents"), sf_dir)


def through(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs through all stages; a stage's table is deleted when the next one's is written, the last one's when the program ends."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    until_exit(spark, at)
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        discard_all()
        if last:
            delete(spark, f"{at}/{last}")
        docs, last = spark.read.parquet(f"{at}/{name}"), name
    return docs
