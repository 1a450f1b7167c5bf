"""The pipeline's rows against the same five stages by brute force."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontam, minhash_dedup, mixing, sharding, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    got = sorted((r.doc_id, r.region, r.rack, r.shard) for r in corpus_pipeline.run(spark, SF).select("doc_id", "region", "rack", "shard").collect())
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").toPandas()
    docs, labels, bench = read("documents"), read("labels"), read("benchmark")

    lab = labels.dropna().groupby("doc_id")["toxic"].max()
    known = docs[docs["doc_id"].isin(lab.index) & docs["text"].notna()].assign(toxic=lambda d: d["doc_id"].map(lab)).sort_values(["text", "toxic"], kind="stable")
    scorer = toxicity.Scorer(toxicity.fit(known["text"].tolist(), known["toxic"].to_numpy() == 1))
    score = np.concatenate([scorer(pa.array([t], pa.string()))[0] for t in docs["text"]])
    docs = docs[score < scorer.threshold].sort_values("doc_id").reset_index(drop=True)

    root = minhash_dedup.brute_force(list(zip(docs["doc_id"], docs["text"])))
    docs = docs[[root[i] == i for i in range(len(docs))]]

    bad = {d for d, _ in decontam.brute_force(list(zip(docs["doc_id"], docs["text"])), list(zip(bench["item_id"], bench["text"])))}
    docs = docs[~docs["doc_id"].isin(bad)]

    con = duckdb.connect()
    con.register("documents", docs)
    con.execute(f"create table mixed as select * from documents where doc_id in (select doc_id from ({mixing.sql()}))")
    assert got == sorted(con.execute(sharding.sql(table="mixed")).fetchall()) and got


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == [*docs.columns, "region", "rack", "shard"]


def test_odd_and_empty_tables_pass_all_stages(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing columns; then no rows at all."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = " ".join(f"t{i % 997}" for i in range(60_000))
    rows = [(None, None, None, None, None), (None, "a b c", None, "odd", 5), (9001, None, "en", "odd", None), (9002, "", None, None, 0), (9003, "same odd text here", "en", "odd", 18), (9003, "same odd text here", "en", "odd", 18), (9004, "same odd text here", "en", "odd", 18), (9005, long, "en", "odd", len(long))]
    odd = spark.createDataFrame(rows, base.schema)
    clash = ("node", "key", "__node", "root", "score", "Shard", "block", "seeds")
    docs = base.union(odd).withColumns({c: F.lit(c) for c in clash})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.where("doc_id is null").count() <= 2
    got = corpus_pipeline.through(spark, docs, SF).collect()
    ids = [r.doc_id for r in got]
    assert ids.count(9003) <= 1 and 9004 not in ids and all(r.region and r.rack and r.shard for r in got)
    first = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_toxic(spark, docs, SF), SF)
    assert {9001, 9002, 9003, 9005} <= {r.doc_id for r in first.select("doc_id").collect()} and first.where("doc_id is null").count() == 2
    assert corpus_pipeline.through(spark, docs.where("false"), SF).count() == 0
