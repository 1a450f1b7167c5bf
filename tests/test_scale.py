"""What large tables need: work stays in a document's row, copies aren't expanded into pairs, folds don't hold what they read."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import constants as K
from textloom.functions import text as T
from textloom.operators import graph, index, search, similarity, structure, vocabulary
from textloom.sources import store

TEXTS = ["", "\n", "# A\r\n\nx\n## B\n", "no heading\n", "pre\n# A\n#\n####### seven\n###### six\nlast", "```\n# in code\n```\n# A"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(f"p{i}.md", t) for i, t in enumerate(TEXTS)], "path string, content string")


def test_sections_come_from_their_row(odd):
    """Two joins under a union, as before, were zipped with unequal numbers of partitions on a cluster."""
    want = set()
    for i, t in enumerate(TEXTS):
        lines = [re.sub("\r$", "", x) for x in t.split("\n")]
        lines = lines[:-1] if lines[-1] == "" else lines
        at = [(n, m) for n, x in enumerate(lines, 1) if (m := re.match(r"^(#{1,6})\s+(.+)$", x))]
        ends = [n - 1 for n, _ in at[1:]] + [len(lines)]
        parts = [(m[2], len(m[1]), n, z) for (n, m), z in zip(at, ends)] or [("Full Document", 0, 1, len(lines))]
        want |= {(f"p{i}.md", *p, "\n".join(lines[p[2] - 1 : p[3]])) for p in parts}
    assert {tuple(r) for r in structure.sections(odd).collect()} == want
    assert {tuple(r) for r in structure.spans(odd).collect()} == {r[:-1] for r in want if r[2]}
    for f in (structure.sections, structure.spans):
        assert not any(x in plan(f(odd)) for x in ("Exchange", "Join", "Union"))


WORDY = ["# Testing settings\nthe Settings, testings settingness tests\n    code words\nKelvin K kelvin\n", "plain tests of testing\n## Tests\nx_1-y", "a of\n", "## Deployments\n", "deploy"]


@pytest.fixture(scope="module")
def wordy(spark):
    return spark.createDataFrame([(f"p{i}.md", t) for i, t in enumerate(WORDY)], "path string, content string")


def test_words_are_counted_in_their_row(spark, wordy, monkeypatch):
    """Terms, keywords, postings and minima of a document, as before by shuffled groups of (path, term), now from its row."""
    tf, marks, posts = {}, {}, []
    for i, t in enumerate(WORDY):
        path = f"p{i}.md"
        for n, line in enumerate(t.rstrip("\n").split("\n"), 1):
            if line.startswith(("    ", "```")):
                continue
            for w in search.words_py(line):
                tf[path, search.stem_py(w)] = tf.get((path, search.stem_py(w)), 0) + 1
            if m := re.match(r"^(#{1,6})\s+(.+)$", line):
                posts += [(search.stem_py(w), path, n, m[2], len(m[1])) for w in search.words_py(m[2])]
                marks |= {(path, search.stem_py(w)): True for w in search.words_py(m[2])}
    posts += [(search.stem_py(t), p, None, None, None) for p, t in tf]
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    as_text = lambda xs: sorted(map(str, xs))
    assert rows(index.term_freq(wordy)) == as_text((*k, n) for k, n in tf.items())
    assert rows(index.keyword_sets(wordy)) == as_text((*k, k in marks) for k in tf)
    assert rows(index.postings(wordy)) == as_text(posts)
    assert {r.path: r.doc_length for r in index.doc_length(wordy).collect()} == {f"p{i}.md": sum(n for (p, _), n in tf.items() if p == f"p{i}.md") for i in range(len(WORDY))}
    for most in (index.MOST, 1):  # added up at once, or each document alone
        monkeypatch.setattr(index, "MOST", most)
        want = {t: (sum(x[0] == t for x in posts), len(ps := {x[1] for x in posts if x[0] == t}), min(ps)) for t in {x[0] for x in posts}}
        assert {r.term: (r.postings, r.docs) for r in index.postings_count(wordy).collect()} == {t: v[:2] for t, v in want.items()}
        assert {r.term: (r.term_freq, r.doc_freq, r.first_path) for r in vocabulary.frequencies(wordy).collect()} == want
    x = {t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % K.PRIME for _, t in tf}
    minima = {p: [min((x[t] * a + b) % K.PRIME for q, t in tf if q == p) for a, b in K.minhash_coefficients()] for p, _ in tf}
    assert {r.path: r.minhash for r in similarity.minhash(wordy).collect()} == minima
    for f in (index.term_freq, index.keyword_sets, index.postings, similarity.minhash):
        assert "Exchange" not in plan(f(wordy))
    for f in (index.postings_count, vocabulary.frequencies, vocabulary.vocabulary):  # documents are counted without a shuffle of (term, path)
        assert not re.search(r"Exchange hashpartitioning\(term#\d+, path#", plan(f(wordy))) and plan(f(wordy)).count("MapInArrow") == 2 and "Join" not in plan(f(wordy))


def test_a_difference_reads_two_documents(wordy):
    """Only the texts of the two are taken apart, not the corpus."""
    got = {(r.term, r.side) for r in similarity.diff(wordy, "p1.md", "p4.md").collect()}
    assert ("deploy", "only2") in got and ("test", "only1") in got
    assert "Aggregate" not in plan(similarity.keywords(wordy, "p1.md")) and not re.search(r"Exchange hashpartitioning\(path#", plan(similarity.diff(wordy, "p1.md", "p4.md")))


def test_copies_are_no_pairs(spark):
    """200 copies of one text and 60 of one like it are 259 rows, not 33,670; the group's mean counts every copy's pair as before."""
    a = " ".join(f"word{i} tail{i}" for i in range(60))
    texts = [a] * 200 + [a + " extra"] * 60 + ["", "", "quite other words here"]
    docs = spark.createDataFrame([(f"d{i:03}.md", t) for i, t in enumerate(texts)], "path string, content string")
    pairs = similarity.lsh_pairs(docs).collect()
    assert len(pairs) == 259 and {(r.path1, r.path2) for r in pairs if not r.copy} == {("d000.md", "d200.md")}
    assert {r.path2: r.path1 for r in pairs if r.copy} == {f"d{i:03}.md": "d000.md" if i < 200 else "d200.md" for i in range(260) if i not in (0, 200)}
    (link,) = [r for r in similarity.dupes(docs).collect() if not r.copy]
    got = similarity.consolidation(docs).collect()
    assert len(got) == 260 and {r.canonical for r in got} == {"d000.md"}
    assert {r.similarity for r in got} == {round((199 + 60 * link.combined) / 259, 6)}
    assert {(r.first, r.members) for r in similarity.dupes_grouped(docs).collect()} == {("d000.md", 200), ("d200.md", 59)}


def test_shared_terms_by_product_and_by_occurrence():
    rng = np.random.default_rng(1)
    some = lambda n, p: [set(np.flatnonzero(rng.random(40) < p)) for _ in range(n)]
    q, d = some(50, np.linspace(0, 0.9, 40)), [set(), *some(70, 0.3)]
    flat = lambda sets: (np.array([t for s in sets for t in s], np.int64), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    got = similarity.shared(*flat(q), len(q), *flat(d), len(d))
    assert got.tolist() == [[len(x & y) for y in d] for x in q]
    assert similarity.shared(*flat([set()]), 1, *flat(d), len(d)).tolist() == [[0] * len(d)]


def test_sections_are_folded_as_they_pass(spark):
    """As in test_engine, but in batches of three, and no group of all sections is held."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(f"p{i:02}.md", "\n".join(f"# h{j}\n{' '.join(rng.choice('abc') for _ in range(6))}" for j in range(3))) for i in range(20)], "path string, content string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = similarity.section_clusters(docs, least=1)
        got = {(r.path, r.line_start): (r.leader, r.similarity) for r in df.collect()}
        assert "FlatMapGroups" not in plan(df)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    leaders, want = [], {}
    for i, r in enumerate(sorted(similarity.section_fingerprints(docs).collect(), key=lambda r: (r.path, r.line_start))):
        bits = r.sim_lo | r.sim_hi << 32
        like = max(((1 - (bits ^ b).bit_count() / 64, -j) for j, b in leaders), default=(0, 0))
        if like[0] < 0.7:
            leaders.append((i, bits))
            like = (1.0, -i)
        want[r.path, r.line_start] = (-like[1], round(like[0], 6))
    assert got == want and 1 < len(leaders) < 60


def test_characteristic_terms_are_chosen_in_the_row(spark, monkeypatch):
    """Whether all terms' idf or one's is known in the row, the best are the same; a document's terms aren't shuffled to find its own."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(f"p{i}.md", " ".join(f"w{min(rng.randrange(1, 60), rng.randrange(1, 60))}ing tests" for _ in range(40))) for i in range(30)], "path string, content string")
    monkeypatch.setattr(search, "COMMON", 10_000)
    want = sorted(map(tuple, search.doc_terms(docs, ["tests"]).collect()))
    monkeypatch.setattr(search, "COMMON", 3)
    df = search.doc_terms(docs, ["tests"])
    assert sorted(map(tuple, df.collect())) == want and want and not re.search(r"Exchange hashpartitioning\(path#\d+, term#", plan(df))


def test_an_index_holds_rows_of_documents_and_answers_layouts_from_them(spark, odd, tmp_path):
    """terms, postings, headings and fingerprints were written again in each layout, and counts of a document's lines were shuffled."""
    docs = store.build(odd, str(tmp_path / "i"))
    held = {p.name for p in (tmp_path / "i").iterdir()}
    assert {"doc_words", "fingerprints"} <= held and not held & {"term_freq", "keyword_sets", "postings", "doc_length", "headings", "simhash", "section_fingerprints"}
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for name in store.TABLES:
        assert key(docs._textloom_index.table(name, docs)) == key(store.derive(name, odd)), name
    assert "Exchange" not in plan(structure.doc_metrics(odd))
    for w in ("ably", "ousness", "hopefulness", "nationalization", "sing", "s", "ess", "rings", "Ses"):
        low = w.lower()
        assert index.stem_py(w) == next((low[: -len(s)] for s in K.SUFFIXES if len(low) > len(s) + 2 and low.endswith(s)), low)


def test_what_one_task_wrote_is_read_by_many(spark, tmp_path, monkeypatch):
    docs = spark.range(12000).select(F.col("id").alias("path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.sha2(F.concat("id", F.lit("-"), i), 512)), "").alias("content")).coalesce(1)
    monkeypatch.setitem(store._makers, "_one", lambda d: d)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
        read = store.Index(spark, str(tmp_path), True).table("_one", docs)
        busy = read.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert busy > 1


def test_lines_lose_one_return(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(["", "\n", "\r\n", "a\r\r\nb\rc\r", "a\n\n", None])], "i int, t string").select("i", T.lines(F.col("t")).alias("l"))
    assert [r.l for r in got.orderBy("i").collect()] == [[], [""], [""], ["a\r", "b\rc"], ["a", ""], []]


def test_a_shingle_is_digested_once_for_the_document_and_its_section(spark):
    """of the whole and of each section, as if each were told alone."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"é{rng.randrange(50)}" for _ in range(n))
    rows = [("a.md", f"{text(9)}\n# One {text(700)}\r\n{text(4200)}\n## Two\n\n## x\n# Three {text(1)}\n"), ("b.md", text(2)), ("c.md", ""), ("d.md", text(300))]
    docs = spark.createDataFrame(rows, "path string, content string")

    def alone(t: str) -> tuple[int, int]:
        w = t.split()
        d = [int.from_bytes(hashlib.md5(" ".join(s).encode()).digest()[:8], "big") for s in zip(w, w[1:], w[2:])]
        bits = [2 * sum(x >> 63 - i & 1 for x in d) > len(d) for i in range(64)]
        return tuple(sum(b << 31 - i for i, b in enumerate(bits[at : at + 32])) for at in (0, 32))

    assert {(r.path, r.sim_lo, r.sim_hi) for r in similarity.simhash(docs).collect()} == {(p, *alone(t)) for p, t in rows}
    parts = structure.sections(docs).where("level > 0").collect()
    want = {(r.path, r.line_start, *alone(r.content)) for r in parts}
    assert {(r.path, r.line_start, r.sim_lo, r.sim_hi) for r in similarity.section_fingerprints(docs).collect()} == want and len(want) == 4
    assert similarity._fingerprints(["", text(3)])[1] != (0, 0)


@pytest.mark.parametrize("cells, asked", [(2_000_000, 1_000_000), (40, 30)])
def test_scores_for_many_questions_are_ranked_in_tasks(spark, monkeypatch, cells, asked):
    """postings and the scores of all documents for all questions were shuffled."""
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "ASKED", asked)
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}x" for _ in range(n))
    rows = [(f"p{i}.md", text(rng.randrange(1, 60))) for i in range(90)]
    rows += [(f"copy{i}.md", rows[3][1]) for i in range(30)] + [("none.md", "")]
    docs = spark.createDataFrame(rows, "path string, content string").repartition(5)
    asks = [(None if i == 7 else i, None if i == 8 else text(12) + " unknown the") for i in range(20)]
    queries = spark.createDataFrame(asks, "query_id int, text string")
    df = search.bm25_topk_all(docs, queries, 10)
    found = [r for r in df.collect()]
    assert df.schema["query_id"].dataType.simpleString() == "int" and not re.search(r"hashpartitioning\((path|term)#|hashpartitioning\(query_id#\d+, path", plan(df))
    for i, t in asks:
        got = sorted((tuple(r)[1:] for r in found if r.query_id == i), key=lambda x: (-x[1], x[0]))
        assert got == ([tuple(r) for r in search.bm25_topk(docs, search.words_py(t), 10).collect()] if t and i in (0, 3, None) else got) and bool(got) == bool(t) and len(got) <= 10
