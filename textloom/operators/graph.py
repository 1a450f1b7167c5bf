"""Links between documents: edges, references, paths, broken links and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored
from . import index, structure
from .iterate import cut


@stored
def resolved_links(docs: DataFrame) -> DataFrame:
    """links with resolved (the path meant) and anchor, without external ones."""
    l = index.links(docs).where(~T.is_external(F.col("target")))
    return l.withColumn("resolved", T.resolve(F.col("path"), F.col("target"))).withColumn("anchor", T.anchor(F.col("target")))


def inner_links(docs: DataFrame) -> DataFrame:
    """resolved_links whose target is a document."""
    return resolved_links(docs).join(docs.select(F.col("path").alias("resolved")), "resolved", "left_semi")


def _with_section(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (path, line, ..) with src_heading and src_line of the section that their line is in, or nulls: the last heading before it."""
    marks = spans.select("path", F.col("line_start").alias("line"), F.struct(F.col("heading").alias("src_heading"), F.col("line_start").alias("src_line")).alias("here"), F.lit(False).alias("asks"))
    w = W.partitionBy("path").orderBy("line", "asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = rows.withColumn("asks", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    found = both.withColumn("here", F.last("here", ignorenulls=True).over(w)).where("asks")
    return found.select(*rows.columns, "here.src_heading", "here.src_line")


def adr_index(docs: DataFrame) -> DataFrame:
    """normalized_id, adr_path: the decision record of each number, the last path if several have it."""
    low = F.lower("path")
    number = F.regexp_extract("path", r"ADR[-_]?(\d{2,4})", 1)
    n = number.cast("int").cast("string")
    found = docs.where((low.contains("/adr/") | low.contains("adr-")) & (number != "")).select(F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n).alias("normalized_id"), "path")
    return found.groupBy("normalized_id").agg(F.max("path").alias("adr_path"))


@stored
def edges(docs: DataFrame) -> DataFrame:
    """source, target, kind, anchor, src_heading, src_line, tgt_heading, tgt_line, raw_text; no document leads to itself."""
    spans = structure.spans(docs)
    link = inner_links(docs).where("resolved <> path and (lower(resolved) like '%.md' or lower(resolved) like '%.txt' or lower(resolved) like '%.rst')")
    null = lambda t: F.lit(None).cast(t)
    plain = link.select(F.col("path").alias("source"), F.col("resolved").alias("target"), F.lit("links_to").alias("kind"), "anchor", null("string").alias("src_heading"), null("int").alias("src_line"), null("string").alias("tgt_heading"), null("int").alias("tgt_line"), null("string").alias("raw_text"))
    tgt = spans.select(F.col("path").alias("tp"), F.col("heading").alias("tgt_heading"), F.col("line_start").alias("tgt_line"))
    key = lambda c: F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-"))
    placed = _with_section(link, spans).where("src_line is not null").join(tgt, (F.col("resolved") == F.col("tp")) & key(F.col("tgt_heading")).contains(key(F.col("anchor"))), "left")
    w = W.partitionBy("path", "line", "nth").orderBy(F.col("tgt_line").asc_nulls_last())
    section = placed.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("path").alias("source"), F.col("resolved").alias("target"), F.lit("section_links_to").alias("kind"), "anchor", "src_heading", "src_line", "tgt_heading", "tgt_line", null("string").alias("raw_text"))
    adr = index.adr_refs(docs).join(adr_index(docs), "normalized_id").where("adr_path <> path")
    adr = _with_section(adr, spans)
    adr = adr.select(F.col("path").alias("source"), F.col("adr_path").alias("target"), F.lit("adr_reference").alias("kind"), null("string").alias("anchor"), "src_heading", "src_line", null("string").alias("tgt_heading"), null("int").alias("tgt_line"), "raw_text")
    return plain.unionByName(section).unionByName(adr).distinct()


def resolve_path(docs: DataFrame, asked: list[str], source_root: str = "") -> DataFrame:
    """pos, asked, path: the document that each of a few written paths means, or null.

    Tried in order: as written, without './', normalised, and below source_root; each also with './' in front."""
    rows = []
    for pos, a in enumerate(asked):
        a = a.strip()
        forms = [a, a.removeprefix("./")]
        if source_root and a.startswith(source_root.rstrip("/") + "/"):
            forms.append(a[len(source_root.rstrip("/")) + 1 :])
        for i, x in enumerate(f for f in forms if f):
            rows.append((pos, asked[pos], i, x))
    q = docs.sparkSession.createDataFrame(rows, "pos int, asked string, nth int, form string")
    tried = F.array("form", T.normal_path(F.col("form")), F.concat(F.lit("./"), F.regexp_replace("form", r"^(\./)+", "")))
    each = q.select("pos", "asked", "nth", F.posexplode(tried).alias("way", "path"))
    # a few rows for each path that was written
    hit = docs.select("path").join(F.broadcast(each), "path").groupBy("pos").agg(F.min(F.struct("nth", "way", "path"))["path"].alias("path"))
    return q.select("pos", "asked").distinct().join(hit, "pos", "left")


def backlinks(docs: DataFrame, path: str) -> DataFrame:
    return resolved_links(docs).where(F.col("resolved") == path).select("path", "line", "text", "target")


def inbound_counts(docs: DataFrame) -> DataFrame:
    """path, inbound of every document: repeated links count, links to what isn't there don't."""
    n = resolved_links(docs).groupBy(F.col("resolved").alias("path")).agg(F.count("*").alias("n"))
    return docs.select("path").join(n, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("inbound"))


def orphans(docs: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    out = docs.select("path").join(resolved_links(docs).select(F.col("resolved").alias("path")), "path", "left_anti")
    for x in exclude or []:
        out = out.where(~F.col("path").contains(x))
    return out


def canonicality(docs: DataFrame, threshold: float = 0.0) -> DataFrame:
    c = T.canonicality(F.col("path"))
    band = F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    return docs.select("path", c.alias("score"), F.array_join(T.canonicality_reasons(F.col("path")), "; ").alias("reasons")).where(F.col("score") >= threshold).withColumn("band", band)


def canonical_orphans(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    return inbound_counts(docs).where("inbound = 0").select("path", T.canonicality(F.col("path")).alias("score")).where(F.col("score") >= threshold)


def paths(docs: DataFrame, source: str, depth: int = 1, kind: str | None = None) -> DataFrame:
    """source, target, kind, hop: edges whose source is fewer than depth (1 to 3) steps away.

    As many joins as steps; each step's new documents are few beside the edges."""
    e = edges(docs).select("source", "target", "kind").distinct()
    if kind:
        e = e.where(F.col("kind") == kind)
    # the document of that path, or else the first whose path ends in it
    exact = F.when(F.col("path") == source, 0).when(F.endswith("path", F.lit("/" + source.removeprefix("./"))), 1)
    start = docs.select(F.struct(exact.alias("k"), "path").alias("x")).where("x.k is not null").agg(F.min("x").alias("x"))
    frontier, seen = start.where("x is not null").select(F.col("x.path").alias("source")), None
    out = None
    for hop in range(min(max(depth, 1), 3)):
        step = e.join(frontier, "source", "left_semi").withColumn("hop", F.lit(hop + 1))
        out = step if out is None else out.unionByName(step)
        seen = frontier if seen is None else seen.union(frontier)
        frontier = step.select(F.col("target").alias("source")).distinct().join(seen, "source", "left_anti")
    return out


def graph_export(docs: DataFrame) -> DataFrame:
    """source, target, label of every resolved link, to itself and repeated ones too."""
    return inner_links(docs).select(F.col("path").alias("source"), F.col("resolved").alias("target"), "anchor")


def dot(docs: DataFrame) -> DataFrame:
    """The graph as lines of DOT; order is for whoever writes them."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    label = F.when(F.col("anchor").isNotNull(), F.concat(F.lit(" [label="), q(F.col("anchor")), F.lit("]"))).otherwise("")
    return graph_export(docs).select(F.concat(F.lit("  "), q(F.col("source")), F.lit(" -> "), q(F.col("target")), label, F.lit(";")).alias("line"))


def link_check(docs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """path, line, nth, target, kind, broken of each link: one verdict, decided in the order the cases are written.

    files (path, is_dir) lists what exists besides the documents."""
    l = index.links(docs).withColumn("resolved", T.resolve(F.col("path"), F.col("target"))).withColumn("anchor", T.anchor(F.col("target")))
    known = docs.select(F.col("path").alias("resolved"), F.lit(True).alias("indexed"))
    l = l.join(known, "resolved", "left")
    if files is None:
        l = l.withColumn("is_dir", F.lit(None).cast("boolean"))
    else:
        l = l.join(files.select(F.col("path").alias("resolved"), "is_dir"), "resolved", "left")
    slugs = index.headings(docs).select(F.col("path").alias("resolved"), T.slug(F.col("text")).alias("anchor"), F.lit(True).alias("has_anchor")).distinct()
    l = l.join(slugs, ["resolved", "anchor"], "left")
    code = T.is_code(F.col("resolved"))
    kind = (
        F.when(T.is_external(F.col("target")), "external")
        .when(T.is_placeholder(F.col("target")), "placeholder")
        .when(F.col("indexed").isNull() & F.col("is_dir").isNull(), F.when(code, "code_missing").otherwise("doc_missing"))
        .when(F.col("anchor").isNotNull() & F.col("indexed").isNotNull() & F.col("has_anchor").isNull(), "anchor_missing")
        .when(F.col("anchor").isNotNull() & F.col("indexed").isNull(), "anchor_unverified")
        .when(F.col("is_dir"), "directory_reference")
        .when(F.col("indexed").isNull(), F.when(code, "code_reference").otherwise("external_reference"))
        .otherwise("ok")
    )
    return l.select("path", "line", "nth", "target", kind.alias("kind")).withColumn("broken", F.col("kind").isin("placeholder", "code_missing", "doc_missing", "anchor_missing", "anchor_unverified"))


def link_kind_counts(docs: DataFrame) -> DataFrame:
    """path, kind, n: by file and kind, and with path null by kind alone."""
    return link_check(docs).groupingSets([["path", "kind"], ["kind"]], "path", "kind").agg(F.count("*").alias("n"))


def link_summary(docs: DataFrame) -> DataFrame:
    return link_check(docs).agg(F.count("*").alias("total"), F.count_if(~F.col("broken")).alias("valid"), F.count_if("broken").alias("broken"))


def link_context(docs: DataFrame) -> DataFrame:
    """path, line, nth, context: the line of each link, cut to 160 bytes."""
    l = index.lines(docs).select("path", F.col("line_no").alias("line"), F.col("line").alias("text_line"))
    cut = F.when(F.octet_length("text_line") > 160, F.concat(F.substring("text_line", 1, 157), F.lit("..."))).otherwise(F.col("text_line"))
    return index.links(docs).select("path", "line", "nth").join(l, ["path", "line"]).select("path", "line", "nth", cut.alias("context"))


def stale(docs: DataFrame, as_of: Column, mtime: Column, days: int = 90, min_inlinks: int = 0) -> DataFrame:
    """path, age_days, inbound of the documents at least days old with at least min_inlinks links to them."""
    age = docs.select("path", F.datediff(as_of, mtime).alias("age_days"))
    return age.join(inbound_counts(docs), "path").where((F.col("age_days") >= days) & (F.col("inbound") >= min_inlinks))


def _lost(docs: DataFrame) -> DataFrame:
    """resolved_links to no document, placeholders aside."""
    lost = resolved_links(docs).where("resolved <> path").join(docs.select(F.col("path").alias("resolved")), "resolved", "left_anti")
    return lost.where(~T.is_placeholder(F.col("target")))


def link_fixes(docs: DataFrame) -> DataFrame:
    """path, line, nth, target, candidate, candidates: documents of the same file name, for each broken link to a document."""
    named = docs.select(F.col("path").alias("candidate"), T.base_name(F.col("path")).alias("name"))
    pairs = _lost(docs).withColumn("name", T.base_name(F.col("resolved"))).join(named, "name")
    here = F.concat(T.parent(F.col("path")), F.lit("/"))
    shown = F.when((T.parent(F.col("path")) != "") & F.col("candidate").startswith(here), F.expr("substring(candidate, length(regexp_replace(path, '(^|/)[^/]*$', '')) + 2)")).otherwise(F.col("candidate"))
    out = pairs.withColumn("candidates", F.count("*").over(W.partitionBy("path", "line", "nth")))
    return out.select("path", "line", "nth", "target", shown.alias("candidate"), "candidates")


def _anchored(path: Column) -> Column:
    return F.concat(path, F.coalesce(F.concat(F.lit("#"), T.anchor(F.col("target"))), F.lit("")))


def fixes(docs: DataFrame) -> DataFrame:
    """The links with one candidate, and what they become; the anchor stays."""
    f = link_fixes(docs).where("candidates = 1")
    return f.select("path", "line", "nth", "target", _anchored(F.col("candidate")).alias("replacement")).where("replacement <> target")


def proposals(docs: DataFrame) -> DataFrame:
    """The links with several candidates, to be decided."""
    return link_fixes(docs).where("candidates > 1").groupBy("path", "line", "nth", "target").agg(F.array_join(F.sort_array(F.collect_list("candidate")), ",").alias("options"), F.count("*").alias("n"))


def apply_decisions(decided: DataFrame) -> DataFrame:
    """proposals with options and decision (a place in them) as fixes."""
    return decided.where("decision is not null and decision >= 0 and decision < size(split(options, ','))").select("path", "line", "nth", "target", _anchored(F.get(F.split("options", ","), F.col("decision").cast("int"))).alias("replacement"))


def rename_targets(renames: DataFrame) -> DataFrame:
    """old_path, new_path: the newest path of each old one in renames (seq, old_path, new_path).

    A step must come later in the history than the one before, and of several renames of a path the first counts, then the first after that step.
    Chains are followed a step a round, each round a join, as long as any goes on; a history's longest chain is its number of rounds."""
    all_ = renames.select("seq", "old_path", "new_path")
    w = W.partitionBy("old_path").orderBy("seq")
    now = cut(all_.withColumn("r", F.row_number().over(w)).where("r = 1").select("old_path", "new_path", "seq"))
    while True:
        later = all_.select(F.col("old_path").alias("new_path"), F.col("new_path").alias("n2"), F.col("seq").alias("s2"))
        step = now.join(later, "new_path").where("s2 > seq").groupBy("old_path").agg(F.min(F.struct("s2", "n2")).alias("x"))
        if step.isEmpty():
            return now.select("old_path", "new_path")
        now = cut(now.join(step, "old_path", "left").select("old_path", F.coalesce("x.n2", "new_path").alias("new_path"), F.coalesce("x.s2", "seq").alias("seq")))


def renamed_fixes(docs: DataFrame, renames: DataFrame) -> DataFrame:
    """path, line, nth, target, replacement: broken links for which no document has the name, by what became of the old path; the anchor stays."""
    found = link_fixes(docs).select("path", "line", "nth")
    lost = _lost(docs).join(found, ["path", "line", "nth"], "left_anti")
    to = rename_targets(renames).join(docs.select(F.col("path").alias("new_path")), "new_path", "left_semi")
    out = lost.join(to, F.col("resolved") == F.col("old_path"))
    return out.select("path", "line", "nth", "target", _anchored(T.relative(F.col("path"), F.col("new_path"))).alias("replacement"))


def apply_fixes(docs: DataFrame, fixed: DataFrame) -> DataFrame:
    """path, old, new, changed of the documents with fixes (target, replacement): each target is replaced wherever a link names it."""
    each = fixed.select("path", "target", "replacement").distinct().groupBy("path", "target").agg(F.min("replacement").alias("replacement"))
    listed = each.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("target", "replacement"))).alias("f"))
    new = F.aggregate("f", F.col("content"), lambda acc, x: F.replace(acc, F.concat(F.lit("]("), x["target"], F.lit(")")), F.concat(F.lit("]("), x["replacement"], F.lit(")"))))
    return docs.join(listed, "path").select("path", F.col("content").alias("old"), new.alias("new")).withColumn("changed", F.col("old") != F.col("new"))


def rewrite(docs: DataFrame, mappings: list[tuple[str, str]]) -> DataFrame:
    """path, old, new, changed: references replaced one mapping after the other."""
    new = F.col("content")
    for a, b in mappings:
        new = F.replace(new, F.lit(f"]({a})"), F.lit(f"]({b})"))
    return docs.select("path", F.col("content").alias("old"), new.alias("new")).withColumn("changed", F.col("old") != F.col("new"))


def move(docs: DataFrame, old: str, new: str) -> DataFrame:
    """path, line, nth, target of the links that name the moved file; rewrite() changes them."""
    return index.links(docs).where(F.col("target") == old).select("path", "line", "nth", "target", F.lit(new).alias("replacement"))
