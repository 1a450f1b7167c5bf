"""The corpus's vocabulary, in the forms in which its terms are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from . import index


def frequencies(docs: DataFrame) -> DataFrame:
    """term, term_freq (postings), doc_freq (documents), first_path, of terms fit for a vocabulary."""
    return index.term_stats(docs).select("term", F.col("postings").alias("term_freq"), F.col("docs").alias("doc_freq"), "first_path")


def common_terms(docs: DataFrame, n: int = 10) -> DataFrame:
    return frequencies(docs).orderBy(F.desc("term_freq"), F.desc("doc_freq"), "term").limit(n)


def vocabulary(docs: DataFrame, limit: int = 100, stop: tuple[str, ...] = K.VOCABULARY_STOP, include_stemming: bool = False, common: int = 0) -> DataFrame:
    """rank, surface, term, doc_freq, term_freq: the most widespread terms, in written form."""
    f = index.term_stats(docs).select("term", F.col("postings").alias("term_freq"), F.col("docs").alias("doc_freq"), "first_path", F.col("s1.word").alias("s1"), F.col("s2.value").alias("s2"))
    if common:
        f = f.join(F.broadcast(common_terms(docs, common).select("term")), "term", "left_anti")
    # as it is written where it first stands in a heading, or else as the first keyword that is stemmed to it
    written = F.coalesce("s1", "s2", *([F.col("term")] if include_stemming else []))
    out = f.withColumn("surface", written).where(F.col("surface").isNotNull() & ~F.col("surface").isin(*stop) & ~F.col("term").isin(*stop))
    top = out.orderBy(F.desc("doc_freq"), F.desc("term_freq"), "first_path", "term").limit(limit)
    w = W.orderBy(F.desc("doc_freq"), F.desc("term_freq"), "first_path", "term")  # over limit rows
    return top.select(F.row_number().over(w).alias("rank"), "surface", "term", "doc_freq", "term_freq")


def as_prompt(rows: list[str]) -> str:
    """Terms on one line, without control characters."""
    clean = (" ".join("".join(c for c in r if c.isprintable() or c.isspace()).split()) for r in rows)
    return ", ".join(x for x in clean if x)
