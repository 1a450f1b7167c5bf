"""Every query of the engine under its name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import context, evaluation, graph, index, rules, search, similarity, structure, vocabulary
from ..session import prepare
from ..sources import store
from ..sources.store import indexed
from ..sources.synthetic import RENAMES, markdown_corpus, raw_corpus
from .oracle import ABSENT

SELF, OTHER = "docs/adr/ADR-000-0.md", "docs/architecture/overview-1.md"
START = "notes/page-99.rst"  # where walks of the graph begin
TWINS = "src/module-185/README.md", "src/module-195/README.md"  # two documents that share headings
RULES = [
    {"pattern": "**/adr/*.md", "name": "records", "must_contain": ["Status:"], "must_not_contain": ["TODO"], "min_length": 5, "max_length": 40, "required_headings": ["Overview"]},
    {"pattern": "*.txt", "severity": "warning", "forbidden_headings": ["Overview"], "max_section_length": 6, "section_heading_regex": "^[AO]", "must_link_to": ["docs/index/topic-8.md"]},
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/{name}.parquet")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return indexed(raw_corpus(table(spark, d, "documents")), f"raw:{d}")


def md(spark: SparkSession, d: str) -> DataFrame:
    return indexed(markdown_corpus(table(spark, d, "documents")), f"md:{d}")


def question(spark: SparkSession, d: str) -> list[str]:
    """The first five words of a benchmark item, and one that no document has."""
    text = table(spark, d, "benchmark").where("item_id = 0").first()["text"]
    return [*list(dict.fromkeys(search.words_py(text)))[:5], ABSENT]


def phrase(spark: SparkSession, d: str) -> list[str]:
    return search.words_py(table(spark, d, "benchmark").where("item_id = 0").first()["text"], stop=False)[:2]


def over(corpus: Callable[[SparkSession, str], DataFrame], f: Callable[..., DataFrame], *args, **kw) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(corpus(spark, d), *args, **kw)


def asked(corpus: Callable[[SparkSession, str], DataFrame], f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(corpus(spark, d), question(spark, d))


def rounded(f: Callable[[SparkSession, str], DataFrame], *cols: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(spark, d).withColumns({c: F.round(c, 6) for c in cols})


def _stale(spark: SparkSession, d: str) -> DataFrame:
    docs = md(spark, d)
    mtime = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    return graph.stale(docs, F.lit("2025-02-15").cast("date"), mtime, 90, 1)


def _history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RENAMES)], "seq int, old_path string, new_path string")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """The proposals, each decided by its line."""
    return graph.apply_decisions(graph.proposals(md(spark, d)).withColumn("decision", F.col("line") % F.col("n")))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return rules.verdict(md(spark, d), [{"pattern": "**/adr/*.md", "must_contain": ["Status:"]}], stale=_stale(spark, d))


def _built(spark: SparkSession, d: str) -> DataFrame:
    """name, rows of each table of an index, built anew."""
    folder = f"{store.shared_dir(spark)}/textloom-build-{spark.sparkContext.applicationId}"
    docs = store.build(table(spark, d, "documents").transform(markdown_corpus), folder)
    of = docs._textloom_index
    parts = [docs.agg(F.lit("docs").alias("name"), F.count("*").alias("rows"))] + [of.table(n, docs).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in store.TABLES]
    return reduce(DataFrame.unionByName, parts)


def _rewritten(spark: SparkSession, d: str) -> DataFrame:
    docs = md(spark, d)
    return graph.apply_fixes(docs, graph.fixes(docs)).where("changed").select("path", F.md5("new").alias("new_md5"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    docs = md(spark, d)
    return similarity.near_sections(docs, docs.where("doc_id % 20 = 0"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well length ranks the documents of each source that are labelled good."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("question_id"), F.col("doc_id").alias("path"), "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("n_chars"), "path")))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("path"))
    return evaluation.ranking_metrics(ranked, docs.join(good, "path"))


def _budget(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("rank"), T.tokens_estimate(F.col("text")).alias("tokens"))
    return context.budget_prefix(rows, 8000, "source").select("source", "rank", "used")


def _refined(spark: SparkSession, d: str) -> DataFrame:
    s = structure.sections(md(spark, d)).select("path", "heading", "line_start", "content")
    return context.refined(s, question(spark, d), 100)


QUERIES |= {
    "bm25_topk": asked(raw, search.bm25_topk),
    "bm25_topk_all": lambda s, d: search.bm25_topk_all(raw(s, d), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")),
    "term_freq": over(raw, index.term_freq),
    "doc_length": over(raw, index.doc_length),
    "corpus_stats": rounded(over(raw, index.corpus_stats), "avg_doc_length"),
    "idf": rounded(over(raw, index.idf), "idf"),
    "keyword_sets": over(md, index.keyword_sets),
    "postings_count": over(md, index.postings_count),
    "index_stats": over(md, index.index_stats),
    "top_keywords": over(md, index.top_keywords),
    "doc_terms": asked(raw, search.doc_terms),
    "query_diagnostics": asked(raw, search.diagnostics),
    "phrase_query": lambda s, d: search.phrase_ranked(raw(s, d), question(s, d), [phrase(s, d)]),
    "phrase_required": lambda s, d: search.phrase_ranked(raw(s, d), question(s, d), [phrase(s, d)], required=True),
    "simhash": over(raw, similarity.simhash),
    "minhash": over(raw, similarity.minhash_slots),
    "lsh_pairs": over(raw, similarity.lsh_pairs),
    "dupes": over(raw, similarity.dupes),
    "dupes_group": over(raw, similarity.dupes_grouped),
    "similar": over(raw, similarity.similar, SELF),
    "similar_all": lambda s, d: similarity.similar_all(raw(s, d), raw(s, d).where("doc_id % 20 = 0")),
    "diff_keywords": over(md, similarity.diff, SELF, OTHER),
    "diff_headings": over(md, similarity.diff_headings, *TWINS),
    "exact_dupes": over(raw, similarity.exact_dupes),
    "headings": over(md, index.headings),
    "links": over(md, index.links),
    "adr_refs": over(md, index.adr_refs),
    "sections": lambda s, d: structure.sections(md(s, d)).select("path", "heading", "level", "line_start", "line_end", F.md5("content").alias("content_md5")),
    "doc_metrics": over(md, structure.doc_metrics),
    "section_metrics": over(md, structure.section_metrics),
    "health": over(md, structure.health, max_lines=20, max_parts=2, max_completed=5, max_changelog=1),
    "health_status": over(md, structure.health_status, max_lines=20, max_parts=2, max_completed=5, max_changelog=1),
    "edges": over(md, graph.edges),
    "backlinks": over(md, graph.backlinks, SELF),
    "inbound_counts": over(md, graph.inbound_counts),
    "orphans": over(md, graph.orphans, ["archive"]),
    "canonicality": lambda s, d: graph.canonicality(md(s, d)).drop("reasons"),
    "canonical_orphans": over(md, graph.canonical_orphans),
    "paths_d1": over(md, graph.paths, START, 1),
    "paths_d2": over(md, graph.paths, START, 2),
    "paths_d3": over(md, graph.paths, START, 3),
    "graph_export": over(md, graph.graph_export),
    "graph_dot": over(md, graph.dot),
    "link_check": over(md, graph.link_check),
    "link_summary": over(md, graph.link_summary),
    "link_kind_counts": over(md, graph.link_kind_counts),
    "link_context": over(md, graph.link_context),
    "stale": _stale,
    "fix_links": over(md, graph.fixes),
    "fix_proposals": over(md, graph.proposals),
    "fix_references": lambda s, d: graph.rewrite(md(s, d), [("TODO", "docs/todo.md"), ("docs/todo.md", "docs/tasks.md")]).where("changed").select("path", F.md5("new").alias("new_md5")),
    "move_refs": over(md, graph.move, "TODO", "docs/todo.md"),
    "policy": over(md, rules.check, RULES),
    "check_verdict": _checked,
    "index_build": _built,
    "fix_renamed": lambda s, d: graph.renamed_fixes(md(s, d), _history(s)),
    "fix_decisions": _decided,
    "fix_applied": _rewritten,
    "rename_targets": lambda s, d: graph.rename_targets(_history(s)),
    "resolve_path": lambda s, d: graph.resolve_path(md(s, d), ["./" + SELF, "docs/../" + START, "/srv/corpus/" + OTHER, "none.md"], "/srv/corpus"),
    "relative_links": lambda s, d: graph.inner_links(md(s, d)).select("path", "resolved", T.relative(F.col("path"), F.col("resolved")).alias("relative")),
    "section_references": lambda s, d: context.references(md(s, d), structure.sections(md(s, d))),
    "heading_matches": lambda s, d: search.matching_headings(md(s, d), md(s, d), ["overview", "Completed"]),
    "file_sections": lambda s, d: search.file_sections(md(s, d), [SELF, START, *TWINS], []).drop("content"),
    "file_sections_ranked": lambda s, d: search.file_sections(md(s, d), [SELF, START, *TWINS], question(s, d)).drop("content"),
    "doc_ranking": lambda s, d: search.doc_ranking(context.ranked_sections(md(s, d), question(s, d), 20)),
    "vocabulary_frequencies": over(md, vocabulary.frequencies),
    "common_terms": over(md, vocabulary.common_terms),
    "vocabulary": over(md, vocabulary.vocabulary),
    "section_fingerprints": over(md, similarity.section_fingerprints),
    "consolidation": over(raw, similarity.consolidation),
    "near_sections": _near,
    "dupes_sections": over(md, similarity.section_clusters),
    "section_search": lambda s, d: search.sections_ranked(md(s, d), question(s, d)).drop("content"),
    "sentence_scores": over(raw, context.sentence_scores, ["the", "que"]),
    "dedupe_content": lambda s, d: context.dedupe_content(raw(s, d).select(F.col("doc_id").alias("rank"), "content")).select("rank"),
    "budget_prefix": _budget,
    "ranking_metrics": _metrics,
    "refine": _refined,
    "assemble": lambda s, d: context.assemble(md(s, d), " ".join(question(s, d))),
    "search_context": lambda s, d: context.search_context(md(s, d), " ".join(question(s, d))),
    "eval": lambda s, d: evaluation.evaluate(md(s, d), [{"id": 1, "q": " ".join(question(s, d)), "expect": question(s, d)[:2]}]).drop("missing", "ranked"),
}
