"""Where results go: JSON, DOT, Markdown, proposals, artifacts, and changed or moved files.

Tables are written by Spark; what changes a user's files is planned as a table and done by a separate call."""

from __future__ import annotations

import hashlib
import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, graph
from . import store


def as_json(df: DataFrame) -> DataFrame:
    """value: each row as JSON, without nulls."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_json(df: DataFrame, folder: str) -> None:
    as_json(df).write.mode("overwrite").text(folder)


def write_dot(docs: DataFrame, folder: str) -> None:
    """The link graph as DOT: head, edges and tail are files of one folder, to be read in the order of their names."""
    spark = docs.sparkSession
    store.delete(spark, folder)
    for part, lines in (("0-head", spark.createDataFrame([("digraph documents {",)], "line string")), ("1-edges", graph.dot(docs)), ("2-tail", spark.createDataFrame([("}",)], "line string"))):
        lines.write.text(f"{folder}/{part}")


def write_digest(docs: DataFrame, question: str, path: str, max_tokens: int = 8000, **how) -> str:
    """assemble() as Markdown in a file: at most max_tokens come to the driver."""
    rows = context.assemble(docs, question, max_tokens, **how).orderBy("rank").collect()
    text = context.digest(rows, question or "selected files", max_tokens)
    Path(path).write_text(text)
    return text


# --- artifacts --------------------------------------------------------------------------


def put_artifacts(found: DataFrame, folder: str) -> None:
    """search_context()'s rows, under their handles; the first two digits of a handle are its folder, so a lookup reads little."""
    cols = ["handle", "path", "heading", "line_start", "line_end", "content"]
    found.select(*cols, F.substring("handle", 5, 2).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(folder)


def get_artifact(spark: SparkSession, folder: str, handle: str, max_tokens: int = 4000, max_bytes: int = 20000) -> dict:
    if not store.exists(spark, folder):
        return {"error": "unknown_handle", "handle": handle}
    rows = spark.read.schema("handle string, path string, heading string, line_start int, line_end int, content string, prefix string").parquet(folder)
    return context.fetch_context(rows.where(F.col("prefix") == handle[4:6]), handle, max_tokens, max_bytes)


def fingerprint(about: dict) -> str:
    """The name of an index by when it was built, its version and its number of files."""
    return f"idx_{context.fnv1a('|'.join(str(about[k]) for k in ('indexed_at', 'version', 'n_docs')).encode()):016x}"


def trace_id(seed: str, now_ns: int | None = None) -> str:
    return f"trc_{context.fnv1a((time.time_ns() if now_ns is None else now_ns).to_bytes(16, 'little') + seed.encode()):016x}"


# --- files ------------------------------------------------------------------------------


def write_changed(changed: DataFrame, root: str, dry_run: bool = False) -> list[str]:
    """Writes the new content of changed (path, old, new, changed) below root, a file at a time; a file that isn't as it was read is left alone."""
    done = []
    for r in changed.where("changed").select("path", F.sha2("old", 256).alias("was"), "new").toLocalIterator():
        at = Path(root, r.path)
        if not dry_run:
            if not at.is_file() or hashlib.sha256(at.read_bytes()).hexdigest() != r.was:
                continue
            at.write_text(r.new)
        done.append(r.path)
    return done


def write_proposals(proposals: DataFrame, path: str) -> int:
    """graph.proposals() as a file to be decided in; JSON, which is YAML too."""
    listed = [{"source": r.path, "line": r.line, "nth": r.nth, "broken_target": r.target, "candidates": r.options.split(","), "decision": None} for r in proposals.orderBy("path", "line", "nth").collect()]
    Path(path).write_text(json.dumps({"version": 1, "proposals": listed}, indent=2))
    return len(listed)


def move_file(docs: DataFrame, root: str, old: str, new: str, update: bool = True, dry_run: bool = False) -> list[str]:
    """Moves a file and, with update, rewrites the links that name it; the documents that change."""
    changed = write_changed(graph.rewrite(docs, [(old, new)]), root, dry_run) if update else []
    if not dry_run:
        Path(root, new).parent.mkdir(parents=True, exist_ok=True)
        os.replace(Path(root, old), Path(root, new))
    return changed
