"""Sections, counts and health of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored
from . import index


def is_part(text: Column) -> Column:
    return F.lower(text).rlike(r"^part [0-9]")


def is_completion(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("done") | low.contains("complete") | low.contains("resolved")


def is_changelog(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("changelog") | low.contains("release notes") | low.endswith("changes") | low.endswith("history")


def parts_of(docs: DataFrame) -> DataFrame:
    """path, l (lines), parts (heading, level, line_start, line_end of each section): from a document's own row, so nothing is joined or shuffled."""
    rx = r"^(#{1,6})\s+(.+)$"
    # generators of one row keep the lines from being split, and the headings from being sought, once for each use
    l = docs.select("path", F.explode(F.array(T.lines(F.col("content")))).alias("l"))
    at = l.select("path", "l", F.explode(F.array(F.filter(F.transform("l", lambda x, i: F.when(x.rlike(r"^#{1,6}\s+.+$"), i + 1)), lambda n: n.isNotNull()))).alias("at"))
    part = lambda n, j: F.struct(
        F.regexp_extract(F.element_at("l", n), rx, 2).alias("heading"),
        F.length(F.regexp_extract(F.element_at("l", n), rx, 1)).alias("level"),
        n.alias("line_start"),
        F.coalesce(F.get("at", j + 1) - 1, F.size("l")).alias("line_end"),
    )
    return at.select("path", "l", F.transform("at", part).alias("parts"))


def pieces_of(docs: DataFrame) -> DataFrame:
    """path, parts, pieces (texts of all lines in order: those before the first section, which may be none, and of each section)."""
    text = lambda start, end: F.array_join(F.slice("l", start, F.greatest(end - start + 1, F.lit(0))), "\n")
    before = text(F.lit(1), F.coalesce(F.get("parts", F.lit(0))["line_start"] - 1, F.size("l")))
    return parts_of(docs).select("path", "parts", F.concat(F.array(before), F.transform("parts", lambda s: text(s["line_start"], s["line_end"]))).alias("pieces"))


@stored
def spans(docs: DataFrame) -> DataFrame:
    """path, heading, level, line_start, line_end of each section; a document without a heading is none."""
    return parts_of(docs).select("path", F.inline("parts"))


@stored
def sections(docs: DataFrame) -> DataFrame:
    """spans with content; a document without a heading is one section, "Full Document"."""
    whole = F.array(F.struct(F.lit("Full Document").alias("heading"), F.lit(0).alias("level"), F.lit(1).alias("line_start"), F.size("l").alias("line_end")))
    text = lambda s: F.array_join(F.slice("l", s["line_start"], F.greatest(s["line_end"] - s["line_start"] + 1, F.lit(0))), "\n")
    names = ("heading", "level", "line_start", "line_end")
    parts = F.when(F.size("parts") > 0, F.col("parts")).otherwise(whole)
    return parts_of(docs).select("path", F.inline(F.transform(parts, lambda s: F.struct(*[s[c].alias(c) for c in names], text(s).alias("content")))))


def _lead(rows: DataFrame) -> DataFrame:
    """rows (l, ..) with frontmatter_keys, and metadata_lines: 'Key: value' lines after the front matter, up to a blank line or heading."""
    close = F.when(F.get("l", F.lit(0)) == "---", F.array_position(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))), "---").cast("int")).otherwise(0)
    keys = F.when(F.col("c") > 0, F.size(F.filter(F.slice("l", 2, F.greatest(F.col("c") - 1, F.lit(0))), lambda x: x.contains(":")))).otherwise(0)
    at = rows.withColumn("c", F.coalesce(close, F.lit(0))).withColumns({"frontmatter_keys": keys.cast("long"), "closed": F.when(F.col("c") > 0, F.col("c") + 1).otherwise(0)})
    rest = F.slice("l", F.col("closed") + 1, F.greatest(F.size("l") - F.col("closed"), F.lit(0)))
    ends = lambda x: (F.trim(x) == "") | x.startswith("#")
    # the lines until the first that ends them: true, and the count so far, while there was none
    step = lambda acc, x: F.when(~acc["on"] | ends(x), F.struct(F.lit(False).alias("on"), acc["n"].alias("n"))).otherwise(F.struct(acc["on"].alias("on"), (acc["n"] + x.rlike(r"^[A-Za-z][A-Za-z0-9 _-]*:[ \t]+[^ \t]").cast("long")).alias("n")))
    return at.withColumn("metadata_lines", F.aggregate(rest, F.struct(F.lit(True).alias("on"), F.lit(0).cast("long").alias("n")), step)["n"]).drop("c", "closed")


@stored
def doc_metrics(docs: DataFrame) -> DataFrame:
    """A row of counts for each document, from its own row."""
    of = lambda a, f: F.size(F.filter(a, f)).cast("long")
    heads = lambda f: of("parts", lambda s: f(s["heading"]))
    level = lambda f: of("parts", lambda s: f(s["level"]))
    link = F.aggregate(F.filter("l", lambda x: x.contains("](")), F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(index.LINK)))
    return _lead(parts_of(docs)).select(
        "path",
        F.regexp_count(F.array_join("l", "\n"), F.lit("[A-Za-z0-9_][A-Za-z0-9_-]*")).cast("long").alias("words"),
        "frontmatter_keys", "metadata_lines",
        F.size("l").cast("long").alias("line_count"),
        F.ceil(of("l", lambda x: x.startswith("```")) / 2).cast("long").alias("code_blocks"),
        of("l", lambda x: x.rlike(r"^\s*([-*+]|[0-9]+\.)\s+")).alias("list_items"),
        of("l", lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2).alias("table_rows"),
        F.size("parts").cast("long").alias("headings"),
        *[level(lambda n, k=k: n == k).alias(f"h{k}") for k in (1, 2, 3)],
        level(lambda n: n >= 4).alias("h4_plus"),
        heads(is_part).alias("part_headings"), heads(is_completion).alias("completion_headings"), heads(is_changelog).alias("changelog_headings"),
        F.size("parts").cast("long").alias("sections"),
        F.coalesce(F.array_max(F.transform("parts", lambda s: s["line_end"] - s["line_start"] + 1)), F.lit(0)).cast("long").alias("longest_section"),
        link.cast("long").alias("links"),
    )


@stored
def section_metrics(docs: DataFrame) -> DataFrame:
    """A row of counts and flags for each section."""
    s = sections(docs).where("level > 0")
    l = F.split("content", "\n", -1)
    count = lambda rx: F.size(F.filter(l, lambda x: x.rlike(rx))).cast("long")
    return s.select(
        "path", "heading", "level", "line_start", "line_end",
        (F.col("line_end") - F.col("line_start") + 1).cast("long").alias("line_count"),
        F.regexp_count("content", F.lit("[A-Za-z0-9_][A-Za-z0-9_-]*")).cast("long").alias("word_count"),
        F.regexp_count("content", F.lit(r"\[[^\]\n]+\]\([^)\n]+\)")).cast("long").alias("link_count"),
        count(r"^\s*([-*+]|[0-9]+\.)\s+").alias("list_item_count"),
        F.ceil(F.size(F.filter(l, lambda x: x.startswith("```"))) / 2).cast("long").alias("code_block_count"),
        is_completion(F.col("heading")).alias("has_completion_marker"), is_part(F.col("heading")).alias("looks_like_part"), is_changelog(F.col("heading")).alias("looks_like_changelog"),
    )


def health(docs: DataFrame, max_lines: int = 500, max_parts: int = 8, max_completed: int = 50, max_changelog: int = 15) -> DataFrame:
    """path, kind, severity, value, threshold of each issue."""
    m, s = doc_metrics(docs), section_metrics(docs)
    done = s.where("has_completion_marker").groupBy("path").agg(F.sum("line_count").alias("completed"))
    log = s.where("looks_like_changelog").groupBy("path").agg(F.sum("list_item_count").alias("entries"))
    full = m.join(done, "path", "left").join(log, "path", "left").na.fill(0)
    rules = (("bloated-file", "error", "line_count", max_lines, ">"), ("accumulator-pattern", "error", "part_headings", max_parts, ">="), ("stale-completed", "warning", "completed", max_completed, ">"), ("changelog-bloat", "warning", "entries", max_changelog, ">"))
    found = [F.when(F.expr(f"{c} {op} {limit}"), F.struct(F.lit(k).alias("kind"), F.lit(sev).alias("severity"), F.col(c).cast("long").alias("value"), F.lit(limit).cast("long").alias("threshold"))) for k, sev, c, limit, op in rules]
    return full.select("path", F.inline(F.array_compact(F.array(*found))))


def health_status(docs: DataFrame, **limits: int) -> DataFrame:
    """path, status: unhealthy with an error, warning with a warning, or healthy."""
    worst = health(docs, **limits).groupBy("path").agg(F.max((F.col("severity") == "error").cast("int")).alias("e"))
    return docs.select("path").join(worst, "path", "left").select("path", F.when(F.col("e") == 1, "unhealthy").when(F.col("e") == 0, "warning").otherwise("healthy").alias("status"))
