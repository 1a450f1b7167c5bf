"""Context under a budget: choosing, refining and cutting sections of documents."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from . import graph, index, search, structure
from .iterate import cut

MARKER = " ...[truncated]"


# --- text under a budget ----------------------------------------------------------------


def truncate(text: str, max_tokens: int, max_bytes: int) -> tuple[str, bool, list[str]]:
    """text within 4 bytes a token and max_bytes (0: no cap), cut between characters, with a marker if it fits."""
    raw = text.encode()
    by_tokens = 4 * max_tokens
    caps = [(by_tokens, "token_cap"), (max_bytes, "byte_cap")]
    broken = [(c, why) for c, why in caps if 0 < c < len(raw)]
    if not broken:
        return text, False, []
    limit = min(c for c, _ in broken)
    room = min([c for c in (by_tokens, max_bytes if max_bytes > len(MARKER) else 0) if c > 0], default=0)
    if room > len(MARKER):
        limit = min(limit, room - len(MARKER))
    out = raw[:limit].decode(errors="ignore").rstrip()
    if room > len(MARKER) and len(out.encode()) + len(MARKER) <= room:
        out += MARKER
    return out, True, [why for _, why in broken]


_BLOCK = re.compile(r"```[\s\S]*?```")
_ITEM = re.compile(r"^[ \t]*[-*+][ \t]+.+$", re.M)
_SUB = re.compile(r"^#{2,6}[ \t]+.+$", re.M)


def sentences(body: str) -> list[str]:
    """Pieces between . ! ? of more than ten bytes that begin with a letter, digit or '#'; fenced code is never cut."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m.group())
        return f"{len(kept) - 1}"

    out = []
    for s in re.split(r"[.!?]", _BLOCK.sub(hide, body)):
        s = s.strip()
        shown = re.sub("(\\d+)", lambda m: kept[int(m.group(1))], s)
        if len(s.encode()) > 10 and (s[0].isalnum() or s[0] == "#"):
            out.append(shown)
    return out


def sentence_score(s: str, terms: list[str], first: bool, crossref: bool) -> float:
    low = s.lower()
    score = 2.0 * sum(t in low for t in terms) + 1.5 * sum(k in low for k in K.DOMAIN)
    score += 3.0 * any(c in s for c in K.CODE_CUES) + 0.3 * first
    return score + 1.0 * (crossref and any(c in low for c in K.CROSS_CUES))


def refine(content: str, terms: list[str], max_tokens: int) -> tuple[str, bool, list[str]]:
    """The best sentences of a section, then its code, lists and subheadings that they don't hold."""
    head, _, rest = content.partition("\n")
    heading, body = (head.strip(), rest) if head.strip().startswith("#") else ("", content)
    parts = sentences(body)
    if not parts:
        return content, False, []
    cross = "adr" in body.lower() or ("[" in body and "](" in body)
    scored = sorted(enumerate(parts), key=lambda p: (-sentence_score(p[1], terms, p[0] == 0, cross), p[0]))
    out = [heading] if heading else []
    out += [s for _, s in scored[: max(6, math.ceil(0.4 * len(parts)))]]
    for item in [*_BLOCK.findall(body), *(m.group() for m in _ITEM.finditer(body)), *(m.group() for m in _SUB.finditer(body))]:
        if not any(item in p for p in out):
            out.append(item)
    return truncate("\n\n".join(out), max_tokens, 0)


def refined(sections: DataFrame, words: list[str], max_tokens: int) -> DataFrame:
    """sections with content refined, truncated and reasons; in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            done = [refine(x or "", words, max_tokens) for x in s]
            yield pd.DataFrame({"content": [d[0] for d in done], "truncated": [d[1] for d in done], "reasons": [",".join(d[2]) for d in done]})

    udf = F.pandas_udf(run, "content string, truncated boolean, reasons string")
    return sections.withColumn("r", udf("content")).drop("content").select("*", "r.*").drop("r")


def sentence_scores(docs: DataFrame, words: list[str]) -> DataFrame:
    """path, nth, score of each sentence of plain documents, as columns: no Python."""
    pieces = F.filter(F.transform(F.split("content", "[.!?]"), lambda x: F.regexp_replace(x, "^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda s: (F.octet_length(s) > 10) & s.rlike("^[A-Za-z0-9#]"))
    low, s = F.lower("s"), F.col("s")

    def total(cues, weight: float, text: Column) -> Column:
        out = F.lit(0.0)
        for c in cues:
            out = out + F.when(text.contains(c), weight).otherwise(0.0)
        return out

    code = F.lit(False)
    for c in K.CODE_CUES:
        code = code | s.contains(c)
    score = total(words, 2.0, low) + total(K.DOMAIN, 1.5, low) + F.when(code, 3.0).otherwise(0.0) + F.when(F.col("nth") == 0, 0.3).otherwise(0.0)
    return docs.select("path", F.posexplode(pieces).alias("nth", "s")).select("path", "nth", F.round(score, 6).alias("score"))


# --- choosing ---------------------------------------------------------------------------


def dedupe_content(sections: DataFrame) -> DataFrame:
    """sections (rank, content, ..) without those whose content, white space aside, an earlier rank has; empty ones stay."""
    key = T.squeeze(F.col("content"))
    w = W.partitionBy("key").orderBy("rank")
    return sections.withColumn("key", key).withColumn("r", F.row_number().over(w)).where("r = 1 or key = ''").drop("key", "r")


def budget_prefix(rows: DataFrame, cap: int, group: str | None = None) -> DataFrame:
    """rows (rank, tokens, ..) as long as their tokens' running sum is within cap."""
    w = (W.partitionBy(group).orderBy("rank") if group else W.orderBy("rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= cap)


def fold_dedupe(p: pd.DataFrame) -> pd.DataFrame:
    """Sections in order of rank without those that overlap a kept one or repeat a content seen before."""
    kept: list[int] = []
    seen: set[str] = set()
    spans: dict[str, list[tuple[int, int]]] = {}
    for i, r in enumerate(p.sort_values("rank").itertuples()):
        here = spans.setdefault(r.path, [])
        overlap = any(a <= r.line_end and r.line_start <= z for a, z in here)
        key = " ".join(r.content.split())
        again = bool(key) and key in seen
        seen.add(key)
        if not overlap and not again:
            kept.append(i)
            here.append((r.line_start, r.line_end))
    return p.sort_values("rank").iloc[kept]


def crossref_budget(max_tokens: int, primary: int, depth: int) -> int:
    return max(0, min(max_tokens - primary, int(0.3 * max_tokens), 2000)) if depth > 0 else 0


PICKS = {"adr": (3, ("context", "decision", "consequences", "motivation", "rationale", "summary")), "design": (2, ()), "ops": (2, ("deploy", "restart", "rollback", "monitor", "troubleshoot", "debug", "fix", "restore")), "other": (1, ())}


def picked_sections(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each target (path, refs, anchor) the sections that its kind of document calls for, with type_rank, refs, nth."""
    kind = T.doc_type(F.col("path"))
    s = structure.sections(docs.join(targets.select("path"), "path", "left_semi")).join(targets, "path").withColumn("kind", kind)
    low = F.lower("heading")
    w = W.partitionBy("path").orderBy("line_start")
    s = s.withColumn("n", F.row_number().over(w))
    hit = F.lit(False)
    for k, (_, cues) in PICKS.items():
        any_cue = F.lit(False)
        for c in cues:
            any_cue = any_cue | low.contains(c)
        hit = hit | ((F.col("kind") == k) & any_cue)
    slug = F.replace(T.slug(F.col("heading")), F.lit("_"), F.lit("-"))
    at = F.coalesce(F.col("anchor").isNotNull() & slug.contains(F.replace(T.slug(F.col("anchor")), F.lit("_"), F.lit("-"))), F.lit(False))
    s = s.withColumn("hit", F.when(F.col("kind") == "design", at).otherwise(hit)).withColumn("hits", F.count_if("hit").over(W.partitionBy("path")))
    ok = (
        F.when(F.col("kind") == "adr", F.col("hit") | (F.col("n") == 1))
        .when(F.col("kind") == "design", F.when(F.col("hits") > 0, F.col("hit")).otherwise(F.col("n") <= 2))
        .when(F.col("kind") == "ops", F.when(F.col("hits") > 0, F.col("hit")).otherwise(F.col("n") == 1))
        .otherwise(F.col("n") == 1)
    )
    most = F.when(F.col("kind") == "adr", 3).when(F.col("kind") == "ops", 2).when((F.col("kind") == "design") & (F.col("hits") == 0), 2).otherwise(1)
    rank = F.when(F.col("kind") == "adr", 0).when(F.col("kind") == "design", 1).when(F.col("kind") == "ops", 2).otherwise(3)
    return s.where(ok).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("path", "heading", "line_start", "line_end", "content", "refs", "nth", rank.alias("type_rank"))


_SECTION = "path string, heading string, line_start int, line_end int, content string"


def references(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """origin, target, anchor of what some sections (path, content, ..) refer to: their links to texts, images aside, and decision records."""
    rx = r"(!?)\[([^\]]+)\]\(([^)]+)\)"
    found = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(rx), F.lit(i)).alias(n) for i, n in ((1, "image"), (3, "target"))])
    link = sections.select("path", F.explode(found).alias("x")).select("path", "x.*").where((F.col("image") == "") & ~T.is_external(F.col("target")))
    link = link.select(F.col("path").alias("origin"), T.resolve(F.col("path"), F.col("target")).alias("target"), T.anchor(F.col("target")).alias("anchor"))
    link = link.where(F.lower("target").rlike(r"\.(md|txt|rst)$"))
    adr = index.adr_refs(sections.select("path", "content")).join(graph.adr_index(docs), "normalized_id")
    return link.union(adr.select(F.col("path").alias("origin"), F.col("adr_path").alias("target"), F.lit(None).cast("string").alias("anchor"))).distinct()


def crossrefs(docs: DataFrame, primary: DataFrame, budget: int, per_doc: int = 600, by_graph: bool = False) -> DataFrame:
    """Sections that the primary ones (path, content, ..) refer to, within the budgets: in order of kind, number of references and path.

    by_graph takes the edges of the primary documents instead, in order of their number and path.
    The budget left depends on all that was taken before: a fold over the few rows, by one task."""
    own = primary.select("path").distinct()
    if by_graph:
        e = graph.edges(docs).join(F.broadcast(own.withColumnRenamed("path", "source")), "source", "left_semi").select(F.col("source").alias("origin"), "target", "anchor")
    else:
        e = references(docs, primary)
    e = e.join(F.broadcast(own.withColumnRenamed("path", "target")), "target", "left_anti")
    targets = e.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("refs"), F.min("anchor").alias("anchor"))
    s = picked_sections(docs, targets).withColumn("tokens", T.tokens_estimate(F.col("content")))

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        return fold_budget(p, budget, per_doc, by_graph)

    # at most a few sections of each document that some 20 sections refer to
    return s.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fold, f"{_SECTION}, tokens long, rank long")


def fold_budget(p: pd.DataFrame, budget: int, per_doc: int, by_graph: bool = False) -> pd.DataFrame:
    """Sections in order as long as the budgets last; a document stops at its first section that is too much."""
    by = ["refs", "path", "nth"] if by_graph else ["type_rank", "refs", "path", "nth"]
    p = p.sort_values(by, ascending=[c != "refs" for c in by])
    left, keep, used, stopped = budget, [], {}, set()
    for i, r in enumerate(p.itertuples()):
        if left == 0:
            break
        if r.path in stopped:
            continue
        if used.get(r.path, 0) + r.tokens > per_doc or left < r.tokens:
            stopped.add(r.path)
            continue
        used[r.path] = used.get(r.path, 0) + r.tokens
        left -= r.tokens
        keep.append(i)
    out = p.iloc[keep].copy()
    out["rank"] = range(len(out))
    return out[["path", "heading", "line_start", "line_end", "content", "tokens", "rank"]]


class SelectionError(ValueError):
    """Why a selection has no sections: missing_files, no_indexed_files, no_searchable_terms or no_relevant_sections."""

    def __init__(self, kind: str, detail: object = None):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail = kind, detail


def select_sections(docs: DataFrame, question: str, limit: int, files: list[str] | None = None, source_root: str = "") -> DataFrame:
    """rank, path, heading, line_start, line_end, content, bm25, canonicality, combined: the sections for a question, or those of some files."""
    words, _ = search.parse_query(question)
    if files:
        found = graph.resolve_path(docs, files, source_root).orderBy("pos").collect()  # as many rows as files were named
        missing = [r.asked for r in found if r.path is None]
        if missing:
            raise SelectionError("missing_files", missing)
        if not found:
            raise SelectionError("no_indexed_files")
        best = search.file_sections(docs, sorted({r.path for r in found}), words, limit)
    else:
        if not words:
            raise SelectionError("no_searchable_terms")
        best = search.sections_ranked(docs, words, limit)
    w = W.orderBy(F.desc("combined"), "path", "line_start", "line_end", "heading")  # over limit rows
    out = cut(best.withColumn("rank", F.row_number().over(w)))
    if out.isEmpty():
        raise SelectionError("no_relevant_sections", question.strip() or "selected files")
    return out


def ranked_sections(docs: DataFrame, words: list[str], limit: int) -> DataFrame:
    w = W.orderBy(F.desc("combined"), "path", "line_start", "line_end", "heading")  # over limit rows
    return search.sections_ranked(docs, words, limit).withColumn("rank", F.row_number().over(w))


def gathered(docs: DataFrame, first: DataFrame, max_tokens: int, depth: int, by_graph: bool) -> tuple[DataFrame, int]:
    """A selection and what it refers to, in order of rank; and how many sections the selection has."""
    n, spent = first.agg(F.count("*"), F.coalesce(F.sum(T.tokens_estimate(F.col("content"))), F.lit(0))).first()
    cols = ["path", "heading", "line_start", "line_end", "content", "rank", "bm25", "canonicality"]
    out = first.select(*cols)
    xref = crossref_budget(max_tokens, spent, depth)
    if xref:
        more = crossrefs(docs, first, xref, by_graph=by_graph).withColumn("rank", (F.col("rank") + 1_000_000).cast("int")).withColumn("bm25", F.lit(0.0)).withColumn("canonicality", T.canonicality(F.col("path")))
        out = out.unionByName(more.select(*cols))
    return out, n


def assemble(docs: DataFrame, question: str, max_tokens: int = 8000, max_sections: int = 20, depth: int = 1, by_graph: bool = False, files: list[str] | None = None, dedupe: bool = True) -> DataFrame:
    """rank, path, heading, content, tokens, truncated ..: sections for a question and what they refer to, refined, within max_tokens."""
    words, _ = search.parse_query(question)
    all_, _ = gathered(docs, select_sections(docs, question, max_sections, files), max_tokens, depth, by_graph)
    if dedupe:
        schema = f"{_SECTION}, rank int, bm25 double, canonicality double"
        all_ = all_.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda p: fold_dedupe(p.drop(columns="one")), schema)
    all_ = cut(all_)
    cap = max_tokens // max(1, all_.count())
    sized = refined(all_, words, cap).withColumn("tokens", T.tokens_estimate(F.col("content")))
    return budget_prefix(sized, max_tokens).select("rank", "path", "heading", "line_start", "line_end", "content", "tokens", "truncated", "reasons", "bm25", "canonicality")


def digest(rows: list, question: str, max_tokens: int = 8000) -> str:
    """The rows of assemble() as Markdown within about max_tokens: the documents, the sections, the last one cut if over 200 characters of it fit."""
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r["path"], []).append(r)
    weight = lambda r: 0.7 * r["bm25"] + 0.3 * r["canonicality"]
    best = sorted(groups.items(), key=lambda g: (-weight(g[1][0]), g[0]))[:10]
    out = [f"# Context for: {question}", "", f"At most {max_tokens} tokens, {len(rows)} sections.", "", "## Documents", ""]
    out += [f"{i}. {path}: score {weight(g[0]):.2f}, authority {g[0]['canonicality']:.2f}, sections {len(g)}" for i, (path, g) in enumerate(best, 1)]
    out += ["", "## Sections", ""]
    used = len("\n".join(out).encode()) // 4
    for r in rows:
        head = f"### {r['heading']} ({r['path']}:{r['line_start']}-{r['line_end']})\n"
        need = (len(head.encode()) + len(r["content"].encode())) // 4
        if used + need > max_tokens:
            room = 4 * max(0, max_tokens - used)
            if room > 200:
                out += [head, r["content"].encode()[:room].decode(errors="ignore"), "", "(cut here)"]
            else:
                out.append("(the rest is over the budget)")
            break
        out += [head, r["content"], ""]
        used += need
    return "\n".join([*out, "", f"About {used} tokens. Answer from these sections alone, and say what they don't tell."])


# --- bounded search and fetch -----------------------------------------------------------


def fnv1a(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def handle(query: str, path: str, heading: str, start: int, end: int, content: str) -> str:
    """A name for a result that depends on nothing but it."""
    parts = [query.encode(), path.encode(), heading.encode(), start.to_bytes(8, "little"), end.to_bytes(8, "little"), content.encode()]
    return f"ctx_{fnv1a(b''.join(p + bytes([255]) for p in parts)):016x}"


def search_context(docs: DataFrame, query: str, max_results: int = 5, max_tokens: int = 1200, max_bytes: int = 12000) -> DataFrame:
    """rank, handle, path, heading, preview, truncated, reasons, full: the best sections within three caps."""
    words, _ = search.parse_query(query)
    first = ranked_sections(docs, words, max(8, 4 * max_results)).select("path", "heading", "line_start", "line_end", "content", "rank")
    schema = "path string, heading string, line_start int, line_end int, content string, rank long, handle string, preview string, truncated boolean, reasons string"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        unique = fold_dedupe(p)
        n = max(1, min(max_results, len(unique)))
        out, tokens, size = [], 0, 0
        for r in unique.itertuples():
            if len(out) >= max_results:
                break
            text, cut1, why1 = refine(r.content, words, max(40, max_tokens // n))
            text, cut2, why2 = truncate(text, max(40, max_tokens // n), max(160, max_bytes // n))
            t, b = len(text.encode()) // 4, len(text.encode())
            if tokens + t > max_tokens or size + b > max_bytes:
                break
            tokens, size = tokens + t, size + b
            out.append((r.path, r.heading, r.line_start, r.line_end, r.content, r.rank, handle(query, r.path, r.heading, r.line_start, r.line_end, r.content), text, cut1 or cut2, ",".join(dict.fromkeys(why1 + why2))))
        return pd.DataFrame(out, columns=["path", "heading", "line_start", "line_end", "content", "rank", "handle", "preview", "truncated", "reasons"])

    return first.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, schema)


def fetch_context(store: DataFrame, name: str, max_tokens: int = 4000, max_bytes: int = 20000) -> dict:
    """The stored content of a handle within caps; one row."""
    row = store.where(F.col("handle") == name).first()
    if row is None:
        return {"error": "unknown_handle", "handle": name}
    text, cut, why = truncate(row["content"], max_tokens, max_bytes)
    return {"handle": name, "path": row["path"], "heading": row["heading"], "content": text, "truncated": cut, "truncation_reasons": why}
