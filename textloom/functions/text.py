"""Scalar text functions as Spark columns: they run in whole-stage code, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def lines(content: Column) -> Column:
    """Lines without their ends; a text that ends in a line feed has no empty last line."""
    whole = F.coalesce(content, F.lit(""))
    body = F.when(whole.endswith("\n"), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    # the text is gone through once, and only if it has such ends, rather than each line
    clean = F.when(body.contains("\r"), F.regexp_replace(body, r"\r(?=\n|\z)", "")).otherwise(body)
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(clean, "\n", -1))


def prose(content: Column) -> Column:
    """The lines that don't start as code does."""
    return F.filter(lines(content), lambda x: ~(x.startswith("```") | x.startswith("    ")))


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.WORD), F.lit(0))


def words(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case words of three letters or more, in order."""
    low = F.transform(raw_words(text), lambda w: F.lower(w))
    keep = F.filter(low, lambda w: F.length(w) >= 3)
    return F.filter(keep, lambda w: ~w.isin(*stop)) if stop else keep


def stem(word: Column) -> Column:
    """Strips the longest suffix that leaves more than two letters: the shortest head of three or more whose rest is one."""
    return F.regexp_replace(word, f"^(.{{3,}}?)(?:{'|'.join(K.SUFFIXES)})$", "$1")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r]+", " "))


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def normal_path(path: Column) -> Column:
    """Without '.', '..' and empty parts; '..' at the top does nothing."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.regexp_replace(acc, "(^|/)[^/]*$", "")).when(acc == "", x).otherwise(F.concat(acc, F.lit("/"), x))
    return F.aggregate(F.split(path, "/"), F.lit(""), step)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def resolve(source: Column, target: Column) -> Column:
    """The path that a link's target without its anchor means: absolute ones count from the root, an empty one is the source."""
    t = before_anchor(target)
    return F.when(t == "", source).when(t.startswith("/"), normal_path(t)).otherwise(normal_path(F.concat(parent(source), F.lit("/"), t)))


def relative(source: Column, target: Column) -> Column:
    """How a document names another from its own folder: up out of what they don't share, then down."""
    a = F.when(parent(source) == "", F.array().cast("array<string>")).otherwise(F.split(parent(source), "/"))
    b = F.split(target, "/")
    some = F.least(F.size(a), F.size(b) - 1)
    same = lambda acc, i: F.when((acc == i) & (F.get(a, i) == F.get(b, i)), acc + 1).otherwise(acc)
    n = F.when(some > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(some - 1, F.lit(0))), F.lit(0), same)).otherwise(0)
    return F.concat(F.repeat(F.lit("../"), F.size(a) - n), F.array_join(F.slice(b, n + 1, F.size(b) - n), "/"))


def before_anchor(target: Column) -> Column:
    return F.regexp_extract(target, "^([^#]*)", 1)


def anchor(target: Column) -> Column:
    """What follows the first '#', or null."""
    return F.when(F.instr(target, "#") > 0, F.regexp_extract(target, "^[^#]*#(.*)$", 1))


def slug(heading: Column) -> Column:
    return F.replace(F.lower(heading), F.lit(" "), F.lit("-"))


def is_external(target: Column) -> Column:
    return target.rlike("^(https?://|mailto:|ftp://)")


def is_placeholder(target: Column) -> Column:
    low = F.lower(before_anchor(target))
    return low.isin("url", "text", "todo", "link", "tbd") | low.startswith("/path/to/") | low.startswith("../path/to/") | low.contains("replace-me")


def is_code(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(py|ts|tsx|json|yaml|yml|png|svg)$")


CANON_RULES = (
    (0.2, "in an authoritative folder", ("docs/adr/", "docs/architecture/"), "path"),
    (0.15, "in the docs index", ("docs/index/",), "path"),
    (-0.3, "scratch, archive or old", ("scratch", "archive", "old"), "path"),
    (-0.25, "deprecated or backup", ("deprecated", "backup"), "path"),
    (0.1, "readme or index file", ("readme", "index"), "name"),
    (0.1, "guide, runbook or plan", ("guide", "runbook", "plan"), "name"),
)


def _hit(path: Column, needles: tuple[str, ...], where: str) -> Column:
    text = F.lower(path if where == "path" else base_name(path))
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def canonicality(path: Column) -> Column:
    """Authority from 0 to 1 that a path suggests."""
    score = F.lit(0.5)
    for weight, _, needles, where in CANON_RULES:
        score = score + F.when(_hit(path, needles, where), F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def canonicality_reasons(path: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_hit(path, n, w), F.lit(f"{x:+.2f} {why}")) for x, why, n, w in CANON_RULES]))


def doc_type(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("/adr/") | low.contains("adr-"), "adr").when(low.contains("architecture") | low.contains("design"), "design").when(low.contains("runbook") | low.contains("operations") | low.contains("ops"), "ops").otherwise("other")


def hygienic(term: Column) -> Column:
    """Terms fit for a vocabulary."""
    digits = F.length(F.regexp_replace(term, "[^0-9]", ""))
    return F.octet_length(term).between(3, 48) & term.rlike("^[A-Za-z0-9_-]+$") & term.rlike("[A-Za-z]") & (digits * 10 < F.length(term) * 6)


def hash32(x: Column, at: int = 1) -> Column:
    """32 bits of the md5: of its hex digits, eight from at."""
    return F.conv(F.substring(F.md5(x), at, 8), 16, 10).cast("long")
