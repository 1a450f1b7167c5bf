"""The engine on the command line: python -m textloom.cli COMMAND; also an interactive loop and a server of requests on standard input."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .operators import context, evaluation, graph, index, rules, search, similarity, structure, vocabulary
from .sources import files, sinks, store

INDEX = ".textloom"


def _rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    """What is shown: a command's answer, which is small, or its first rows."""
    return [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit)).collect()]


def _one(docs: DataFrame, path: str) -> str:
    found = graph.resolve_path(docs, [path]).first()
    if found is None or found.path is None:
        raise SystemExit(f"not in the index: {path}")
    return found.path


def build(spark: SparkSession, a) -> dict:
    s = files.resolved(files.config(a.config), a.profile, vars(a), {"types": "md,txt,rst", "output": INDEX})
    known = Path(a.path, ".gitignore")
    ignore = [x for f in ([known] if known.is_file() else []) + a.exclude_from for x in Path(f).read_text().splitlines()]
    docs = files.corpus(spark, a.path, tuple(s["types"].split(",")), tuple(a.exclude), tuple(a.roots), tuple(ignore))
    built = store.build(docs, s["output"], int(datetime.now(timezone.utc).timestamp()), a.path)
    if a.renames:
        files.renames(spark, a.renames).write.mode("overwrite").parquet(f"{s['output']}/renames")
    return {"index": s["output"], **_rows(index.index_stats(built))[0]}


def query(spark, docs, a) -> dict:
    words, phrases = search.parse_query(" ".join(a.terms))
    found = search.phrase_ranked(docs, words, phrases, a.limit, a.phrase) if phrases else search.bm25_topk(docs, words, a.limit)
    if a.files_only:
        return {"files": [r["path"] for r in _rows(found)]}
    out = {"results": _rows(found), "headings": _rows(search.matching_headings(docs, found, words))}
    if a.explain:
        out["terms"] = _rows(search.diagnostics(docs, words))
    if a.doc_terms:
        some = search.doc_terms(docs, words, a.doc_terms).join(found.select("path"), "path", "left_semi")
        out["doc_terms"] = _rows(some)
    return out


def diff(spark, docs, a) -> dict:
    p, q = _one(docs, a.one), _one(docs, a.two)
    pair = spark.createDataFrame([(p, q)], "path1 string, path2 string")
    return {"likeness": _rows(similarity.scored_pairs(docs, pair)), "keywords": _rows(similarity.diff(docs, p, q)), "headings": _rows(similarity.diff_headings(docs, p, q))}


def _stale(spark, docs, a) -> DataFrame:
    return graph.stale(docs, F.current_date(), F.col("mtime").cast("date"), a.days, a.min_inlinks)


def check(spark, docs, a) -> dict:
    out: dict = {"verdict": _rows(rules.verdict(docs, files.policy(a.policy) if a.policy else [], tuple(a.fail_on), _stale(spark, docs, a) if a.stale else None))}
    out["failed"] = a.ci and any(r["fails"] for r in out["verdict"])
    return out


def fix_links(spark, docs, a) -> dict:
    if a.decisions:
        fixed = graph.apply_decisions(files.decisions(spark, a.decisions))
    else:
        fixed = graph.fixes(docs)
        at = f"{a.index}/renames"
        if store.exists(spark, at):
            fixed = fixed.unionByName(graph.renamed_fixes(docs, spark.read.parquet(at)))
    out: dict = {"fixes": _rows(fixed)}
    if a.propose:
        out["proposals"] = sinks.write_proposals(graph.proposals(docs), a.propose)
    if a.apply:
        out["changed"] = sinks.write_changed(graph.apply_fixes(docs, fixed), a.root)
    return out


def assemble(spark, docs, a) -> str:
    try:
        rows = context.assemble(docs, a.question, a.max_tokens, a.max_sections, a.depth, a.graph, files.expand(a.from_files)).orderBy("rank").collect()
    except context.SelectionError as e:
        return f"no context: {e}"
    return context.digest(rows, a.question or "selected files", a.max_tokens)


def evaluate(spark, docs, a) -> dict:
    asked = files.questions(spark, a.questions)
    done = evaluation.evaluate(docs, asked).persist()
    metrics = evaluation.evaluate_ranking(done, asked, tuple(a.k))
    out = {"results": _rows(done), "summary": _rows(evaluation.pass_rate(done)), "ranking": _rows(metrics), "averages": _rows(evaluation.averages(metrics))}
    done.unpersist()
    return out


def vocab(spark, docs, a) -> object:
    rows = _rows(vocabulary.vocabulary(docs, a.limit, files.stop_words(a.stopwords), a.include_stemming, a.common))
    return vocabulary.as_prompt([r["surface"] for r in rows]) if a.format == "prompt" else {"terms": rows, "total": vocabulary.frequencies(docs).count()}


def search_context(spark, docs, a) -> dict:
    found = context.search_context(docs, a.question, a.max_results, a.max_tokens, a.max_bytes).persist()
    sinks.put_artifacts(found, f"{a.index}/artifacts")
    out = {"trace": sinks.trace_id(a.question), "index": sinks.fingerprint(store.about(docs)), "results": _rows(found.select("handle", "path", "heading", "line_start", "line_end", "preview", "truncated", "reasons"))}
    found.unpersist()
    return out


def fetch_context(spark, docs, a) -> dict:
    return sinks.get_artifact(spark, f"{a.index}/artifacts", a.handle, a.max_tokens, a.max_bytes)


#: name: (what it does, arguments as (flag, settings))
_N = lambda flag, default, kind=int: (flag, {"type": kind, "default": default})
_YES = lambda flag: (flag, {"action": "store_true"})
_FILE = ("file", {})
COMMANDS: dict[str, tuple[Callable, list]] = {
    "query": (query, [("terms", {"nargs": "+"}), _N("--limit", 10), _N("--doc-terms", 0), _YES("--files-only"), _YES("--phrase"), _YES("--explain")]),
    "similar": (lambda s, d, a: {"results": _rows(similarity.similar(d, _one(d, a.file), a.limit, a.threshold))}, [_FILE, _N("--limit", 5), _N("--threshold", 0.3, float)]),
    "dupes": (lambda s, d, a: {"pairs": _rows((similarity.dupes_grouped if a.group else similarity.dupes)(d, a.threshold))}, [_N("--threshold", 0.35, float), _YES("--group")]),
    "dupes-sections": (lambda s, d, a: {"clusters": _rows(similarity.section_clusters(d, a.threshold, a.min_files))}, [_N("--threshold", 0.7, float), _N("--min-files", 2)]),
    "diff": (diff, [("one", {}), ("two", {})]),
    "stats": (lambda s, d, a: {**_rows(index.index_stats(d))[0], "top": _rows(index.top_keywords(d, a.top))}, [_N("--top", 20)]),
    "health": (lambda s, d, a: {"issues": _rows(structure.health(d))}, []),
    "assemble": (assemble, [("question", {"nargs": "?", "default": ""}), ("--from-files", {"nargs": "*", "default": []}), _N("--max-tokens", 8000), _N("--max-sections", 20), _N("--depth", 1), _YES("--graph")]),
    "eval": (evaluate, [("questions", {}), ("--k", {"nargs": "*", "type": int, "default": [5, 10]})]),
    "vocabulary": (vocab, [_N("--limit", 100), ("--format", {"default": "json", "choices": ["json", "prompt"]}), ("--stopwords", {}), _YES("--include-stemming"), _N("--common", 0)]),
    "check": (check, [("--policy", {}), _YES("--stale"), _N("--days", 90), _N("--min-inlinks", 0), _YES("--ci"), ("--fail-on", {"nargs": "*", "default": ["doc_missing", "code_missing", "anchor_missing", "policy_error"]})]),
    "check-links": (lambda s, d, a: {"links": _rows(graph.link_check(d).where("broken")), "summary": _rows(graph.link_kind_counts(d).where("path is null"))}, []),
    "backlinks": (lambda s, d, a: {"links": _rows(graph.backlinks(d, _one(d, a.file)))}, [_FILE]),
    "orphans": (lambda s, d, a: {"files": _rows(graph.orphans(d, a.exclude))}, [("--exclude", {"nargs": "*", "default": []})]),
    "canonicality": (lambda s, d, a: {"files": _rows(graph.canonicality(d, a.threshold))}, [_N("--threshold", 0.0, float)]),
    "canonical-orphans": (lambda s, d, a: {"files": _rows(graph.canonical_orphans(d, a.threshold))}, [_N("--threshold", 0.7, float)]),
    "fix-links": (fix_links, [("--propose", {}), ("--decisions", {}), _YES("--apply"), ("--root", {"default": "."})]),
    "fix-references": (lambda s, d, a: {"changed": sinks.write_changed(graph.rewrite(d, files.mappings(a.mapping)), a.root, not a.apply)}, [("mapping", {}), _YES("--apply"), ("--root", {"default": "."})]),
    "mv": (lambda s, d, a: {"changed": sinks.move_file(d, a.root, a.old, a.new, a.update_refs, a.dry_run)}, [("old", {}), ("new", {}), _YES("--update-refs"), _YES("--dry-run"), ("--root", {"default": "."})]),
    "stale": (lambda s, d, a: {"files": _rows(_stale(s, d, a))}, [_N("--days", 90), _N("--min-inlinks", 0)]),
    "export-graph": (lambda s, d, a: "digraph documents {\n" + "\n".join(r["line"] for r in _rows(graph.dot(d))) + "\n}" if a.format == "dot" else {"edges": _rows(graph.graph_export(d))}, [("--format", {"default": "json", "choices": ["json", "dot"]})]),
    "paths": (lambda s, d, a: {"edges": _rows(graph.paths(d, a.file, a.depth, a.kind))}, [_FILE, _N("--depth", 1), ("--kind", {})]),
    "suggest-consolidation": (lambda s, d, a: {"groups": _rows(similarity.consolidation(d, a.threshold))}, [_N("--threshold", 0.7, float)]),
    "policy": (lambda s, d, a: {"violations": _rows(rules.check(d, files.policy(a.rules)))}, [("rules", {})]),
    "search-context": (search_context, [("question", {}), _N("--max-results", 5), _N("--max-tokens", 1200), _N("--max-bytes", 12000)]),
    "fetch-context": (fetch_context, [("handle", {}), _N("--max-tokens", 4000), _N("--max-bytes", 20000)]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    p.add_argument("--index", default=INDEX)
    p.add_argument("--profile")
    p.add_argument("--config", default=".textloom.toml")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("path")
    b.add_argument("--types", default="md,txt,rst")
    b.add_argument("--output", default=INDEX)
    b.add_argument("--renames", help="a file of git's log of renames")
    for flag in ("--exclude", "--exclude-from", "--roots"):
        b.add_argument(flag, nargs="*", default=[])
    for name, (_, args) in COMMANDS.items():
        c = sub.add_parser(name)
        for flag, how in args:
            c.add_argument(flag, **how)
    sub.add_parser("repl")
    sub.add_parser("serve")
    return p


def run(spark: SparkSession, docs: DataFrame, args: argparse.Namespace) -> object:
    return COMMANDS[args.command][0](spark, docs, args)


def show(x: object) -> str:
    return x if isinstance(x, str) else json.dumps(x, indent=2, default=str, ensure_ascii=False)


def repl(spark: SparkSession, docs: DataFrame, lines=sys.stdin) -> None:
    """query, similar, dupes, diff, stats and the other commands, a line each, until exit."""
    import shlex

    for line in lines:
        words = shlex.split(line)
        if not words:
            continue
        if words[0] in ("exit", "quit"):
            return
        try:
            print(show(run(spark, docs, parser().parse_args(words))), flush=True)
        except SystemExit as e:
            if e.code and e.code != 2:
                print(e.code, flush=True)


# --- requests on standard input ---------------------------------------------------------

TOOLS = {
    "search_context": ({"query": "string", "max_results": "integer", "max_tokens": "integer", "max_bytes": "integer"}, ["query"], "The best sections for a question, under caps, each with a handle"),
    "fetch_context": ({"handle": "string", "max_tokens": "integer", "max_bytes": "integer"}, ["handle"], "The text that a handle names"),
}


def answer(spark: SparkSession, docs: DataFrame, index_dir: str, request: object) -> dict | None:
    """The response to one JSON-RPC request; None to a notification."""

    def reply(**x) -> dict:
        return {"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None, **x}

    def error(code: int, message: str) -> dict:
        return reply(error={"code": code, "message": message})

    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return error(-32600, "invalid request")
    method, params = request["method"], request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        return reply(result={"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "textloom", "version": str(store.VERSION)}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": need}} for n, (p, need, d) in TOOLS.items()]})
    if method != "tools/call":
        return error(-32601, f"no method {method}")
    name, given = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return error(-32602, f"no tool {name}")
    known, need, _ = TOOLS[name]
    kinds = {"string": str, "integer": int}
    if any(k not in given for k in need) or any(k not in known or not isinstance(v, kinds[known[k]]) or isinstance(v, bool) for k, v in given.items()):
        return error(-32602, f"arguments of {name}: {known}")
    words = [name.replace("_", "-"), given[need[0]], *[x for k, v in given.items() if k != need[0] for x in (f"--{k.replace('_', '-')}", str(v))]]
    args = parser().parse_args(["--index", index_dir, *words[:1], *words[2:], "--", words[1]])
    out = run(spark, docs, args)
    return reply(result={"content": [{"type": "text", "text": show(out)}], "structuredContent": out, "isError": "error" in out})


def serve(spark: SparkSession, docs: DataFrame, index_dir: str, source=None, sink=None) -> None:
    """Messages with a Content-Length header, until the input ends."""
    source, sink = source or sys.stdin.buffer, sink or sys.stdout.buffer
    while True:
        size, line = 0, source.readline()
        if not line:
            return
        while line.strip():
            head, _, value = line.decode().partition(":")
            if head.strip().lower() == "content-length":
                size = int(value)
            line = source.readline()
        try:
            out = answer(spark, docs, index_dir, json.loads(source.read(size)))
        except json.JSONDecodeError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if out is not None:
            body = json.dumps(out, default=str, ensure_ascii=False).encode()
            sink.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
            sink.flush()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session.build("textloom")
    if args.command == "build":
        print(show(build(spark, args)))
        return 0
    args.index = files.resolved(files.config(args.config), args.profile, {"index": args.index}, {"index": INDEX})["index"]
    docs = store.load(spark, args.index)
    if args.command == "repl":
        repl(spark, docs)
    elif args.command == "serve":
        serve(spark, docs, args.index)
    else:
        out = run(spark, docs, args)
        print(show(out))
        return int(isinstance(out, dict) and bool(out.get("failed")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
