"""The index on files, selections and their budgets, repairs, the command line and the server, on a small corpus of files."""

import io
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.functions import text as T
from textloom.operators import context, evaluation, graph, rules, search, similarity, structure
from textloom.sources import files, sinks, store
from textloom.streaming import upkeep

FILES = {
    "README.md": "# Guide\n\nSee [plan](docs/plan.md#the-goal) and [gone](docs/lost.md) and ![pic](pic.png).\n\nADR-001 decides.\n",
    "docs/plan.md": "---\nowner: me\n---\n# Plan\n\n## The goal\n\nKubernetes deployment plan for authentication.\nBack to [readme](../README.md) and [self](#plan).\n\n## Done parts\n\n- one\n- two\n",
    "docs/adr/ADR-001-first.md": "# First decision\n\nStatus: accepted\n\n## Context\n\nThe authentication service restarts often.\n\n## Decision\n\nUse async-migration for the deployment plan.\n",
    "docs/adr/ADR-002-copy.md": "# First decision\n\nStatus: accepted\n\n## Context\n\nThe authentication service restarts often.\n\n## Decision\n\nUse async-migration for the deployment plan now.\n",
    "docs/new/lost.md": "# Lost and found\n\nRestart the service: see [old](../old/name.md#x) and [two](twin.md).\n",
    "docs/a/twin.md": "# Twin\n\ntext\n",
    "docs/b/twin.md": "# Twin\n\ntext\n",
    "docs/current.md": "# Current\n\ntext\n",
    ".hidden/x.md": "# No\n",
    "node_modules/y.md": "# No\n",
    "secret/z.md": "# No\n",
    "code.py": "x = 1\n",
    "bad.md": b"\xff\xfe\xfa",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    for p, t in FILES.items():
        (at / p).parent.mkdir(parents=True, exist_ok=True)
        (at / p).write_bytes(t if isinstance(t, bytes) else t.encode())
    return at


@pytest.fixture(scope="module")
def docs(spark, root, tmp_path_factory):
    found = files.corpus(spark, str(root), exclude=("secret/**",))
    return store.build(found, str(tmp_path_factory.mktemp("index") / "i"), 7, str(root))


def test_corpus_takes_what_it_should(spark, root, docs):
    want = {p for p in FILES if p.endswith(".md") and not p.startswith((".", "node_modules", "secret", "bad"))}
    assert {r.path for r in docs.collect()} == want
    paths = lambda **how: {r.path for r in files.corpus(spark, str(root), **how).select("path").collect()}
    assert paths(types=("py",)) == {"code.py"} and paths(roots=("docs/adr",)) == {p for p in want if p.startswith("docs/adr")}
    assert paths(ignore=("docs/*", "!docs/adr", "secret/")) == {"README.md"} | {p for p in want if p.startswith("docs/adr")}
    assert {r.content for r in docs.where("path = 'README.md'").collect()} == {FILES["README.md"]}


def test_index_is_what_is_derived_and_errors_where_it_lacks(spark, docs, tmp_path):
    plain = docs.select("*")
    assert not hasattr(plain, "_textloom_index") and store.about(docs)["n_docs"] == docs.count()
    for f in (graph.edges, structure.sections, structure.doc_metrics, similarity.section_fingerprints):
        key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert key(f(docs)) == key(f(plain))
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))
    docs.write.parquet(str(tmp_path / "part/docs"))
    part = store.load(spark, str(tmp_path / "part"))
    assert graph.edges(part).count() == 0  # an index may lack its graph
    with pytest.raises(FileNotFoundError):
        structure.sections(part)


def test_links_are_repaired(spark, root, docs, tmp_path):
    log = tmp_path / "log"
    log.write_text("b" * 40 + "\nR100\tdocs/old/mid.md\tdocs/current.md\n\n" + "a" * 40 + "\nR090\tdocs/old/name.md\tdocs/old/mid.md\n")
    history = files.renames(spark, str(log))
    assert [tuple(r) for r in history.orderBy("seq").collect()] == [(1, "docs/old/name.md", "docs/old/mid.md", "a" * 40), (2, "docs/old/mid.md", "docs/current.md", "b" * 40)]
    assert files.renames(spark, str(tmp_path / "no")).count() == 0
    assert {tuple(r)[3:] for r in graph.fixes(docs).collect()} == {("docs/lost.md", "docs/new/lost.md")}
    assert {(r.target, r.replacement) for r in graph.renamed_fixes(docs, history).collect()} == {("../old/name.md#x", "../current.md#x")}
    at = tmp_path / "proposals.yaml"
    assert sinks.write_proposals(graph.proposals(docs), str(at)) == 1
    plan = json.loads(at.read_text())
    assert plan["proposals"][0]["candidates"] == ["docs/a/twin.md", "docs/b/twin.md"]
    plan["proposals"][0]["decision"] = 1
    at = at.with_suffix(".json")
    at.write_text(json.dumps(plan))
    decided = graph.apply_decisions(files.decisions(spark, str(at)))
    assert [r.replacement for r in decided.collect()] == ["docs/b/twin.md"]
    changed = graph.apply_fixes(docs, graph.fixes(docs))
    assert sinks.write_changed(changed, str(root), dry_run=True) == ["README.md"] and "(docs/lost.md)" in (root / "README.md").read_text()
    assert sinks.write_changed(changed, str(root)) == ["README.md"] and "(docs/new/lost.md)" in (root / "README.md").read_text()
    assert sinks.write_changed(changed, str(root)) == []  # it isn't any more what was read
    (root / "README.md").write_text(FILES["README.md"])


def test_files_are_moved(root, docs):
    assert sinks.move_file(docs, str(root), "docs/plan.md#the-goal", "x", dry_run=True) == ["README.md"]
    assert sinks.move_file(docs, str(root), "docs/current.md", "docs/deep/now.md") == [] and (root / "docs/deep/now.md").is_file()
    (root / "docs/deep/now.md").rename(root / "docs/current.md")


@pytest.mark.parametrize("source, target, want", [("a/b/c.md", "a/b/d.md", "d.md"), ("a/b/c.md", "a/d/e.md", "../d/e.md"), ("c.md", "a/d.md", "a/d.md"), ("a/b/c.md", "d.md", "../../d.md"), ("a/c.md", "a/b/d.md", "b/d.md")])
def test_relative_paths(spark, source, target, want):
    assert spark.range(1).select(T.relative(F.lit(source), F.lit(target)).alias("x")).first().x == want


def test_paths_are_looked_up(docs):
    asked = ["docs/plan.md", "./docs/plan.md", "docs/../docs/plan.md", "/r/docs/plan.md", "plan.md"]
    assert [r.path for r in graph.resolve_path(docs, asked, "/r").orderBy("pos").collect()] == ["docs/plan.md"] * 4 + [None]
    assert {r.source for r in graph.paths(docs, "plan.md").collect()} == {"docs/plan.md"}  # by its end
    assert {r.kind for r in graph.paths(docs, "README.md", kind="adr_reference").collect()} == {"adr_reference"}


def test_selections_and_their_errors(docs, tmp_path):
    for how, kind in ((("the of", None), "no_searchable_terms"), (("zzzqx", None), "no_relevant_sections"), (("plan", ["nope.md"]), "missing_files")):
        with pytest.raises(context.SelectionError) as e:
            context.select_sections(docs, how[0], 5, how[1])
        assert e.value.kind == kind
    names = tmp_path / "list"
    names.write_text("docs/plan.md\n\n ./README.md \n")
    assert files.expand(["a.md", f"@{names}"]) == ["a.md", "docs/plan.md", "./README.md"]
    got = context.select_sections(docs, "", 20, files.expand([f"@{names}"])).collect()
    assert {r.path for r in got} == {"docs/plan.md", "README.md"} and {r.bm25 for r in got} == {1.0}


def test_assembled_context(spark, docs):
    rows = context.assemble(docs, "authentication deployment plan").orderBy("rank").collect()
    assert sum(r.tokens for r in rows) <= 8000 and len({(r.path, r.line_start) for r in rows}) == len(rows)
    assert rows[0].rank == 1 and any("async-migration" in r.content for r in rows)
    alone = context.select_sections(docs, "", 20, ["README.md"])
    refs = {(r.target, r.anchor) for r in context.references(docs, alone).collect()}
    assert refs == {("docs/plan.md", "the-goal"), ("docs/lost.md", None), ("docs/adr/ADR-001-first.md", None)}
    more = context.crossrefs(docs, alone, 2000).orderBy("rank").collect()
    assert [r.path for r in more][:3] == ["docs/adr/ADR-001-first.md"] * 3 and more[-1].path == "docs/plan.md"
    by_graph = context.crossrefs(docs, alone, 2000, by_graph=True).collect()
    assert {r.path for r in by_graph} == {"docs/adr/ADR-001-first.md", "docs/plan.md"}
    assert context.crossrefs(docs, alone, 5).count() <= 1
    text = context.digest(rows, "a question", 8000)
    assert text.startswith("# Context for: a question") and all(r.path in text for r in rows)
    big = [dict(r.asDict(), content="word " * 3000) for r in rows[:2]]
    assert "(cut here)" in context.digest(big, "q", 1000) and len(context.digest(big, "q", 1000)) < 4600
    assert "over the budget" in context.digest(big, "q", 60)


def test_folds_against_plain_loops():
    rng = random.Random(1)
    rows = [(rng.choice("ab"), f"h{i}", s := rng.randrange(40), s + rng.randrange(9), rng.choice(["x  y", "x y", "", "z", f"t{i}"]), i) for i in range(60)]
    p = pd.DataFrame(rows, columns=["path", "heading", "line_start", "line_end", "content", "rank"]).sample(frac=1, random_state=2)
    want, kept, seen = [], [], set()
    for r in rows:
        clash = any(k[0] == r[0] and k[2] <= r[3] and r[2] <= k[3] for k in kept)
        again = " ".join(r[4].split()) in seen and r[4].split()
        seen.add(" ".join(r[4].split()))
        if not clash and not again:
            kept.append(r)
            want.append(r[5])
    assert context.fold_dedupe(p)["rank"].tolist() == want
    q = pd.DataFrame([(p_, "h", 1, 2, "c", n, t, k, r) for p_, k, r in (("a", 0, 1), ("b", 0, 3), ("c", 1, 9)) for n, t in ((1, 300), (2, 250), (3, 200))], columns=["path", "heading", "line_start", "line_end", "content", "nth", "tokens", "type_rank", "refs"])
    assert [tuple(x) for x in context.fold_budget(q, 900, 600)[["path", "tokens"]].to_numpy()] == [("b", 300), ("b", 250), ("a", 300)]
    assert [tuple(x) for x in context.fold_budget(q, 900, 600, True)[["path", "tokens"]].to_numpy()] == [("c", 300), ("c", 250), ("b", 300)]


@pytest.mark.parametrize("text, tokens, size, want", [("short", 10, 0, ("short", False, [])), ("x" * 100, 10, 0, ("x" * 25 + context.MARKER, True, ["token_cap"])), ("é" * 50, 0, 41, ("é" * 13 + context.MARKER, True, ["byte_cap"])), ("y" * 100, 20, 30, ("y" * 15 + context.MARKER, True, ["token_cap", "byte_cap"]))])
def test_truncation_by_bytes(text, tokens, size, want):
    assert context.truncate(text, tokens, size) == want


def test_refinement_keeps_code_and_the_best_sentences():
    body = ". ".join(f"Filler sentence number {i} of many" for i in range(30))
    text = f"# Head\n{body}. The deploy service must restart. Then run:\n```\nmake all. now\n```\n- item one\n"
    out, cut, why = context.refine(text, ["restart"], 4000)
    assert out.startswith("# Head") and "restart" in out and "make all. now" in out and "- item one" in out and not cut
    assert len(out) < len(text) and context.refine(text, ["restart"], 50)[1:] == (True, ["token_cap"])


def test_section_clusters_against_a_plain_loop(docs):
    f = sorted(similarity.section_fingerprints(docs).collect(), key=lambda r: (r.path, r.line_start))
    leaders, of = [], {}
    for r in f:
        bits = r.sim_lo | r.sim_hi << 32
        like = [(1 - bin(bits ^ b).count("1") / 64, -i) for i, (_, b) in enumerate(leaders)]
        if like and max(like)[0] >= 0.7:
            of[r.path, r.line_start] = leaders[-max(like)[1]][0]
        else:
            leaders.append(((r.path, r.line_start), bits))
            of[r.path, r.line_start] = (r.path, r.line_start)
    groups: dict = {}
    for k, v in of.items():
        groups.setdefault(v, set()).add(k)
    got: dict = {}
    for r in similarity.section_clusters(docs).collect():
        got.setdefault(r.leader, set()).add((r.path, r.line_start))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1) and got


def test_evaluation(spark, docs, tmp_path):
    at = tmp_path / "q.jsonl"
    at.write_text('{"id": 1, "q": "authentication plan", "expect": ["async-migration", "nowhere"], "min_hits": 1, "relevant_docs": ["docs/plan.md"]}\n\n{"id": 2, "q": "the", "expect": []}\n')
    asked = files.questions(spark, str(at))
    done = evaluation.evaluate(docs, asked)
    got = {r.id: r for r in done.collect()}
    assert (got[1].hits, got[1].missing, got[1].passed, got[2].passed) == (1, ["nowhere"], True, False)
    assert tuple(evaluation.pass_rate(done).first()) == (2, 1, 1, 50.0)
    metrics = evaluation.evaluate_ranking(done, asked)
    assert {r.k: r.recall for r in metrics.collect()} == {5: 1.0, 10: 1.0} and evaluation.averages(metrics).count() == 2
    at.write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.questions(spark, str(at))


def test_settings_and_rules_from_files(docs, tmp_path, capsys):
    (tmp_path / "c.toml").write_text('[index]\noutput = "base"\n[profile.p]\ntypes = "rst"\n')
    s = files.config(str(tmp_path / "c.toml"))
    assert files.resolved(s, "p", {"types": "md", "output": "x"}, {"types": "md", "output": "x"}) == {"types": "rst", "output": "base"}
    assert files.resolved(s, "p", {"types": "txt"}, {"types": "md"}) == {"types": "txt"}
    (tmp_path / "bad.toml").write_text("= 1")
    assert files.config(str(tmp_path / "bad.toml")) is None and "ignored" in capsys.readouterr().err and files.config(str(tmp_path / "no")) is None
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"pattern": "docs/adr/*.md", "must_contain": ["Status:", "Owner"]}]}))
    assert {r.detail for r in rules.check(docs, files.policy(str(tmp_path / "rules.json"))).collect()} == {"Owner"}
    (tmp_path / "stop").write_text("Plan goal")
    assert {"plan", "goal", "the"} <= set(files.stop_words(str(tmp_path / "stop")))
    stale = graph.stale(docs, F.lit("2999-01-01").cast("date"), F.col("mtime").cast("date"))
    kinds = {r.kind: r.fails for r in rules.verdict(docs, [], stale=stale).collect()}
    assert kinds["stale"] is False and kinds["doc_missing"] is True


def test_sinks(spark, docs, tmp_path):
    sinks.write_dot(docs, str(tmp_path / "dot"))
    text = "\n".join(r.value for p in ("0-head", "1-edges", "2-tail") for r in spark.read.text(str(tmp_path / "dot" / p)).collect())
    assert text.startswith("digraph") and '"README.md" -> "docs/plan.md" [label="the-goal"];' in text and text.endswith("}")
    sinks.write_json(docs.select("path"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == docs.count()
    assert "docs/plan.md" in sinks.write_digest(docs, "deployment plan", str(tmp_path / "d.md"))


def test_command_line_and_loop(spark, docs, capsys, monkeypatch):
    folder = docs._textloom_index.folder
    ask = lambda *w: cli.run(spark, docs, cli.parser().parse_args(["--index", folder, *w]))
    assert ask("query", "authentication", "--files-only")["files"] and ask("query", '"async-migration', 'for"', "--phrase", "--explain", "--doc-terms", "2")["results"]
    assert ask("similar", "docs/adr/ADR-001-first.md")["results"][0]["path"] == "docs/adr/ADR-002-copy.md"
    assert ask("dupes")["pairs"] and ask("diff", "docs/a/twin.md", "docs/b/twin.md")["likeness"][0]["jaccard"] == 1.0
    assert ask("check", "--ci")["failed"] and not ask("check", "--ci", "--fail-on", "other")["failed"]
    assert ask("fix-links")["fixes"] and ask("backlinks", "docs/plan.md")["links"] and ask("assemble", "the").startswith("no context")
    assert "digraph" in ask("export-graph", "--format", "dot") and isinstance(ask("vocabulary", "--format", "prompt"), str)
    cli.repl(spark, docs, ["stats", "", "similar nope.md", "exit", "stats"])
    out = capsys.readouterr().out
    assert out.count('"terms"') == 1 and "not in the index" in out


def test_server(spark, docs):
    folder = docs._textloom_index.folder
    send = lambda *m: b"".join(b"Content-Length: %d\r\n\r\n" % len(b := json.dumps(x).encode()) + b for x in m)
    call = lambda i, name, **a: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}}
    asked = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, call(3, "search_context", query="authentication plan", max_results=2), call(4, "fetch_context", handle="ctx_0"), call(5, "none"), call(6, "search_context"), {"jsonrpc": "2.0", "id": 7, "method": "what"}, {"id": 8}]
    sink = io.BytesIO()
    cli.serve(spark, docs, folder, io.BytesIO(send(*asked)), sink)
    got, raw = {}, sink.getvalue()
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(head.split(b":")[1])
        x, raw = json.loads(rest[:n]), rest[n:]
        got[x["id"]] = x
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8} and {got[i]["error"]["code"] for i in (5, 6)} == {-32602} and got[7]["error"]["code"] == -32601 and got[8]["error"]["code"] == -32600
    found = got[3]["result"]["structuredContent"]
    assert 0 < len(found["results"]) <= 2 and found["index"].startswith("idx_") and got[4]["result"]["structuredContent"]["error"] == "unknown_handle"
    first = found["results"][0]
    text = sinks.get_artifact(spark, f"{folder}/artifacts", first["handle"])
    assert text["path"] == first["path"] and text["content"]
    assert context.fnv1a(b"") == 14695981039346656037 and context.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_index_follows_a_stream(spark, docs, tmp_path):
    for i, some in enumerate((docs.where("path < 'docs/b'"), docs.where("path >= 'docs/b'"))):
        some.select("path", "content").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upkeep.follow(spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), availableNow=True).awaitTermination()
    row = lambda df: sorted(map(tuple, df.collect()))
    from textloom.operators import index

    assert row(upkeep.table(spark, str(tmp_path / "out"), "term_freq").select("path", "term", "tf")) == row(index.term_freq(docs).select("path", "term", "tf"))
    assert [(t, d) for t, d, _ in row(upkeep.idf(spark, str(tmp_path / "out")))] == [(t, d) for t, d, _ in row(index.idf(docs))]


def test_prompt_and_headings(docs):
    from textloom.operators.vocabulary import as_prompt

    assert as_prompt(["a\tb", "c\x00d", " "]) == "a b, cd"
    assert {r.text for r in search.matching_headings(docs, docs, ["goals"]).collect()} == {"The goal"}
