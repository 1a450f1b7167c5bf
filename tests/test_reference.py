"""Scalar goldens, and queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evaluation, search
from textloom.plans.oracle import ORACLE
from textloom.plans.queries import QUERIES, raw

SF = "/root/testdata/sf0.001"
CHECKED = ("bm25_topk", "idf", "doc_terms", "postings_count", "query_diagnostics", "ranking_metrics", "canonicality", "headings", "links", "edges", "inbound_counts", "exact_dupes", "budget_prefix", "dedupe_content", "sections", "paths_d3", "fix_links", "fix_renamed", "fix_applied", "near_sections", "similar_all", "bm25_topk_all", "section_references", "consolidation")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("word, stem", [("running", "runn"), ("tests", "test"), ("testing", "test"), ("keywords", "keyword"), ("go", "go"), ("it", "it"), ("deployments", "deployment"), ("settings", "sett"), ("kubernetes", "kubernet"), ("authentication", "authentic"), ("policies", "polic"), ("classes", "class")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.lit(word))) == search.stem_py(word) == stem


def test_words_and_query():
    assert search.words_py("Hello, async-migration!") == ["hello", "async-migration"]
    assert search.words_py("the and of") == []
    words, phrases = search.parse_query('"async migration" plan')
    assert phrases == [["async", "migration"]] and len(words) == 3


def test_every_benchmark_item_is_asked(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {}
    for r in QUERIES["bm25_topk_all"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r.path] = r.score
    assert set(got) == {i.item_id for i in items if search.words_py(i.text or "")} and len(got) > 1
    for item in items[:: max(1, len(items) // 3)]:
        one_by_one = {r.path: r.score for r in search.bm25_topk(raw(spark, SF), search.words_py(item.text)).collect()}
        assert got[item.item_id] == pytest.approx(one_by_one, abs=2e-6)


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", p, i + 1) for i, p in enumerate("abcde")], "question_id string, path string, rank int")
    relevant = spark.createDataFrame([("q", "a"), ("q", "c")], "question_id string, path string")
    got = {r.k: r for r in evaluation.ranking_metrics(ranked, relevant, ks=(1, 2, 5)).collect()}
    assert (got[5].precision, got[1].precision, got[2].precision) == (0.4, 1.0, 0.5)
    assert (got[5].recall, got[1].recall, got[5].mrr) == (1.0, 0.5, 1.0)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    result = con.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(names) and got == want


def test_every_query_has_a_name_and_most_have_sql():
    assert set(ORACLE) <= set(QUERIES) and os.path.isdir(SF)
