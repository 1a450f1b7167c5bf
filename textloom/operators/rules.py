"""Policy rules over documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph, index, structure


def glob_regex(glob: str) -> str:
    """A glob as a regex for whole paths; '*' crosses '/' too, and '**/' may stand for nothing."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            out += ".*"
            i += 2 if glob.startswith("**", i) else 1
            continue
        if c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        if c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
            continue
        out += "." if c == "?" else "\\" + c if c in ".^$+()|\\[]{}" else c
        i += 1
    return f"^{out}$"


def required_target(pattern: str, source):
    """The path that a must_link_to entry means, for each source."""
    p = pattern.removeprefix("./")
    if p.startswith("../") or "/" not in p:
        return T.normal_path(F.concat(T.parent(source), F.lit("/" + p)))
    return T.normal_path(F.lit(p))


def check(docs: DataFrame, rules: list[dict]) -> DataFrame:
    """path, rule, severity, kind, detail of each violation: one select for each condition, over the documents its glob takes."""
    parts: list[DataFrame] = []
    for r in rules:
        some = docs.where(F.col("path").rlike(glob_regex(r["pattern"])))
        name, severity = r.get("name") or r["pattern"], r.get("severity") or "error"

        def add(df: DataFrame, kind: str, detail) -> None:
            parts.append(df.select("path", F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))  # noqa: B023

        for x in r.get("must_contain") or []:
            add(some.where(~F.contains("content", F.lit(x))), "must_contain", F.lit(x))
        for x in r.get("must_not_contain") or []:
            add(some.where(F.contains("content", F.lit(x))), "must_not_contain", F.lit(x))
        n = F.size(T.lines(F.col("content")))
        if r.get("min_length") is not None:
            add(some.where(n < r["min_length"]), "min_length", n)
        if r.get("max_length") is not None:
            add(some.where(n > r["max_length"]), "max_length", n)
        if r.get("required_headings") or r.get("forbidden_headings"):
            h = index.headings(some).select("path", "text").distinct()
            for x in r.get("required_headings") or []:
                add(some.join(h.where(F.col("text") == x), "path", "left_anti"), "required_heading", F.lit(x))
            for x in r.get("forbidden_headings") or []:
                add(some.join(h.where(F.col("text") == x), "path", "left_semi"), "forbidden_heading", F.lit(x))
        if r.get("max_section_length") is not None:
            s = structure.sections(some)
            if r.get("section_heading_regex"):
                s = s.where(F.col("heading").rlike(r["section_heading_regex"]))
            size = F.col("line_end") - F.col("line_start") + 1
            add(s.where(size > r["max_section_length"]), "max_section_length", F.concat_ws(": ", F.concat_ws("@", "heading", F.col("line_start").cast("string")), size.cast("string")))
        for x in r.get("must_link_to") or []:
            want = some.withColumn("resolved", required_target(x, F.col("path")))
            have = graph.resolved_links(some).select("path", "resolved")
            add(want.join(have, ["path", "resolved"], "left_anti"), "must_link_to", F.lit(x))
    empty = docs.where("false").select("path", *[F.lit("").alias(c) for c in ("rule", "severity", "kind", "detail")])
    return reduce(DataFrame.unionByName, parts, empty)


def verdict(docs: DataFrame, rules: list[dict], fail_on: tuple[str, ...] = ("doc_missing", "code_missing", "anchor_missing", "policy_error"), stale: DataFrame | None = None) -> DataFrame:
    """kind, n, fails: what a continuous check finds in links, by policy and of stale documents (graph.stale), and which of it fails the run; staleness never does."""
    links = graph.link_check(docs).where("broken").groupBy("kind").agg(F.count("*").alias("n"))
    policy = check(docs, rules).groupBy(F.concat(F.lit("policy_"), F.when(F.col("severity") == "error", "error").otherwise("warn")).alias("kind")).agg(F.count("*").alias("n"))
    out = links.unionByName(policy)
    if stale is not None:
        out = out.unionByName(stale.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("stale").alias("kind"), "n"))
    return out.withColumn("fails", F.col("kind").isin(*fail_on) & (F.col("kind") != "stale"))
