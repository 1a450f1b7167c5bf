"""An index that follows a stream of new documents: each batch adds its rows to the tables that are derived document by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import store

#: Tables whose rows of a document depend on nothing but it; edges and counts over all documents are derived from these when they are read.
BY_DOCUMENT = ("headings", "links", "adr_refs", "spans", "sections", "term_freq", "doc_length", "keyword_sets", "postings", "resolved_links", "doc_metrics", "section_metrics", "simhash", "minhash", "section_fingerprints")


def _add(batch: DataFrame, number: int, folder: str) -> None:
    """One batch under its own number: a batch that is run again after a failure replaces what it had written."""
    spark = batch.sparkSession
    docs = spark.createDataFrame([], batch.schema) if batch.isEmpty() else batch
    for name, df in (("docs", docs), *((n, store.derive(n, docs)) for n in BY_DOCUMENT)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")


def follow(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Keeps the tables in folder up with stream (path, content, ..), whose paths are new; trigger as for DataStreamWriter.trigger."""
    writer = stream.writeStream.foreachBatch(lambda b, n: _add(b, n, folder)).option("checkpointLocation", f"{folder}/_progress")
    return (writer.trigger(**trigger) if trigger else writer).start()


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/batch=*").drop("batch")


def idf(spark, folder: str) -> DataFrame:
    """term, df, idf over all batches so far."""
    n = F.broadcast(table(spark, folder, "docs").agg(F.count("*").alias("n")))
    df = table(spark, folder, "term_freq").groupBy("term").agg(F.count("*").alias("df"))
    value = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.1))
    return df.crossJoin(n).select("term", "df", value.alias("idf"))
