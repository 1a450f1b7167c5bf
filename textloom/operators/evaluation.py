"""How good a ranking is: precision, recall, reciprocal rank and gain; and questions with expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """question_id, k, precision, recall, mrr, ndcg from ranked (question_id, path, rank from 1) and relevant (question_id, path)."""
    rel = relevant.select("question_id", "path").distinct()
    size = rel.groupBy("question_id").agg(F.count("*").alias("n_rel"))
    hits = ranked.join(rel, ["question_id", "path"])
    first = hits.groupBy("question_id").agg(F.min("rank").alias("first"))
    k = F.explode(F.array(*[F.lit(x) for x in ks]))
    base = size.join(first, "question_id", "left").withColumn("k", k)
    gain = hits.withColumn("k", k).where("rank <= k").groupBy("question_id", "k").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", "k").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = base.join(gain, ["question_id", "k"], "left").na.fill(0, ["hits", "dcg"])
    r = lambda c: F.round(c, 6)
    return out.select("question_id", "k", r(F.col("hits") / F.col("k")).alias("precision"), r(F.col("hits") / F.col("n_rel")).alias("recall"), r(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), r(F.col("dcg") / ideal).alias("ndcg"))


def averages(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("k").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


def pass_rate(results: DataFrame) -> DataFrame:
    """total, passed, failed, pass_rate (per cent) of evaluate()'s rows."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.round(100 * F.avg(F.col("passed").cast("double")), 6), F.lit(0.0)).alias("pass_rate"))


def evaluate(docs: DataFrame, questions: list[dict], max_tokens: int = 8000, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """id, hits, expected, missing, passed, tokens, ranked: whether the digest for each question has the expected strings.

    The sections aren't deduplicated.  The questions are few: each is a run of its own, whose digest of at most max_tokens comes to the driver."""
    rows = []
    for q in questions:
        try:
            chosen = context.assemble(docs, q["q"], max_tokens, dedupe=False).orderBy("rank").collect()
        except context.SelectionError:
            chosen = []
        text = context.digest(chosen, q["q"], max_tokens) if chosen else ""
        low = text.lower()
        missing = [e for e in q["expect"] if e.lower() not in low]
        hits = len(q["expect"]) - len(missing)
        need = q.get("min_hits") if q.get("min_hits") is not None else len(q["expect"])
        ranked = list(dict.fromkeys(r["path"] for r in chosen if r["rank"] < 1_000_000))
        rows.append((q["id"], hits, len(q["expect"]), missing, bool(chosen) and hits >= need, len(text.encode()) // 4, ranked))
    return docs.sparkSession.createDataFrame(rows, "id long, hits int, expected int, missing array<string>, passed boolean, tokens int, ranked array<string>")


def evaluate_ranking(results: DataFrame, questions: list[dict], ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """ranking_metrics of evaluate()'s rows, for the questions that name relevant_docs."""
    spark = results.sparkSession
    relevant = spark.createDataFrame([(q["id"], p) for q in questions for p in q.get("relevant_docs") or []], "question_id long, path string")
    ranked = results.select(F.col("id").alias("question_id"), F.posexplode("ranked").alias("pos", "path")).select("question_id", "path", (F.col("pos") + 1).alias("rank"))
    return ranking_metrics(ranked, relevant, ks)
