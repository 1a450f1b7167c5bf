"""Where a corpus and what is asked of it come from: folders, git logs, question files, rules, settings."""

from __future__ import annotations

import re
import sys
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K

TYPES = ("md", "txt", "rst")
SKIPPED = ("node_modules", ".git/", "target/", "vendor/", "venv/", "__pycache__")


# --- texts ------------------------------------------------------------------------------


def ignored(patterns: list[str]) -> list[tuple[bool, str]]:
    """Lines of ignore files as (whether it ignores, regex of relative paths), in order; the last that matches decides."""
    out = []
    for line in patterns:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        rooted, folder, body = "/" in line.rstrip("/"), line.endswith("/"), line.strip("/")
        rx = "".join("(?:.*/)?" if x == "**/" else ".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|.", body))
        out.append((not keep, ("^" if rooted else "(?:^|.*/)") + rx + ("/.*" if folder else "(?:/.*)?") + "$"))
    return out


def _under(path: Column, roots: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for r in roots:
        r = r.removeprefix("./").strip("/")
        out = out | F.lit(r in ("", ".")) | (path == r) | path.startswith(r + "/")
    return out


def corpus(spark: SparkSession, folder: str, types: tuple[str, ...] = TYPES, exclude: tuple[str, ...] = (), roots: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), content, size_bytes, mtime of a folder's texts of some types.

    Left out: hidden files and folders, what the fixed list of build folders names, what matches a glob of exclude, what
    lines of ignore files (ignore) say, files outside of all roots, and files that aren't UTF-8.  The names are tested on
    the file listing, before any content is read."""
    at = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at)
    plain = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/"), "^" + re.escape("/" + re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "", at).lstrip("/")) + "/+", "")
    rel = files.select(plain.alias("path"), F.col("path").alias("source"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    ok = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[t.lower().lstrip(".") for t in types]) & ~F.col("path").rlike(r"(^|/)\.[^/.]")
    for s in SKIPPED:
        ok = ok & ~F.col("path").contains(s)
    for g in exclude:
        from ..operators.rules import glob_regex

        ok = ok & ~F.col("path").rlike(glob_regex(g))
    if roots:
        ok = ok & _under(F.col("path"), roots)
    verdict = F.lit(False)
    for out, rx in ignored(list(ignore)):
        verdict = F.when(F.col("path").rlike(rx), F.lit(out)).otherwise(verdict)
    text = F.col("content").cast("string")
    return rel.where(ok & ~verdict).select("path", text.alias("content"), "size_bytes", "mtime").where(F.is_valid_utf8("content"))


def renames(spark: SparkSession, log: str) -> DataFrame:
    """seq, old_path, new_path, commit, the oldest first, of the output of `git log --name-status --diff-filter=R --pretty=format:%H -M`; no rows where there is no such file.

    A history's lines are numbered by one task: their order is all that tells whose a rename is."""
    schema = "seq long, old_path string, new_path string, commit string"
    try:
        lines = spark.read.text(log, wholetext=True)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    each = lines.select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    w = W.orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    commit = F.last(F.when(F.col("line").rlike("^[0-9a-f]{40}$"), F.col("line")), ignorenulls=True).over(w)
    rx = r"^R\d*\t([^\t]+)\t([^\t\r]+)\r?$"
    found = each.withColumn("commit", commit).where(F.col("line").rlike(rx))
    return found.select(F.row_number().over(W.orderBy(F.desc("n"))).cast("long").alias("seq"), F.regexp_extract("line", rx, 1).alias("old_path"), F.regexp_extract("line", rx, 2).alias("new_path"), "commit")


# --- what is asked ----------------------------------------------------------------------


def questions(spark: SparkSession, path: str) -> list[dict]:
    """id, q, expect, min_hits, relevant_docs of each line of JSON; blank lines are skipped, a bad line is an error.  Questions are few."""
    schema = "id long, q string, expect array<string>, min_hits int, relevant_docs array<string>"
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"))
    return [r.x.asDict() for r in lines.collect()]


def _yaml(path: str):
    try:
        import yaml
    except ImportError as e:  # it isn't part of every installation
        raise RuntimeError("reading YAML needs the yaml package; JSON is read without it") from e
    return yaml.safe_load(Path(path).read_text())


def _read(path: str):
    if path.endswith(".json"):
        import json

        return json.loads(Path(path).read_text())
    return _yaml(path)


def policy(path: str) -> list[dict]:
    """Rules for rules.check(); every one needs a pattern."""
    rules = (_read(path) or {}).get("rules") or []
    for r in rules:
        if not r.get("pattern"):
            raise ValueError(f"a rule without a pattern in {path}: {r}")
    return rules


def mappings(path: str) -> list[tuple[str, str]]:
    """(from, to) for graph.rewrite(), in order."""
    return [(m["from"], m["to"]) for m in (_read(path) or {}).get("mappings") or []]


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """path, line, nth, target, options, n, decision of a file of proposals, for graph.apply_decisions()."""
    listed = (_read(path) or {}).get("proposals") or []
    rows = [(p["source"], p["line"], p.get("nth", 0), p["broken_target"], ",".join(p["candidates"]), len(p["candidates"]), p.get("decision")) for p in listed]
    return spark.createDataFrame(rows, "path string, line int, nth int, target string, options string, n long, decision int")


def stop_words(path: str | None, known: tuple[str, ...] = K.VOCABULARY_STOP) -> tuple[str, ...]:
    """The words of a file, lower-case, with the known ones."""
    return tuple(sorted({*known, *(Path(path).read_text().lower().split() if path else ())}))


def expand(args: list[str]) -> list[str]:
    """Paths; @list stands for those in a file, one a line."""
    out: list[str] = []
    for a in args:
        out += [x.strip() for x in Path(a[1:]).read_text().splitlines() if x.strip()] if a.startswith("@") else [a]
    return out


# --- settings ---------------------------------------------------------------------------


def config(path: str) -> dict | None:
    """The settings of a TOML file; None without one, or with a warning if it isn't valid."""
    try:
        return tomllib.loads(Path(path).read_text())
    except FileNotFoundError:
        return None
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        print(f"ignored the settings in {path}: {e}", file=sys.stderr)
        return None


def resolved(settings: dict | None, profile: str | None, given: dict, defaults: dict) -> dict:
    """What a profile (or the settings without one) says of index, types, output, roots and the like, where the command line leaves the default."""
    said = dict((settings or {}).get("index") or {}) if isinstance((settings or {}).get("index"), dict) else {}
    if profile:
        named = ((settings or {}).get("profile") or {}).get(profile)
        if named is None:
            raise KeyError(f"no profile {profile}")
        said |= named
    return {k: said[k] if given.get(k, v) == v and k in said else given.get(k, v) for k, v in defaults.items()}
