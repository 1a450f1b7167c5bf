"""Tables derived from a corpus (path, content): terms, lengths, postings, statistics."""

from __future__ import annotations

import re
from collections import Counter
from itertools import accumulate, chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..sources.store import stored, view


def lines(docs: DataFrame) -> DataFrame:
    """path, line_no (from 1), line."""
    return docs.select("path", F.posexplode(T.lines(F.col("content"))).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


_HEADS = "array<struct<line: int, level: int, text: string, words: array<string>, terms: array<string>>>"
_WORDS = f"path string, doc_length long, terms array<string>, counts array<int>, in_heading array<boolean>, again array<string>, heads {_HEADS}"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
KNOWN = 1 << 18  # words whose stems a task remembers
MOST = 200_000  # terms that a task adds up at once


def stem_py(word: str) -> str:
    w = word.lower()
    if w.endswith(K.SUFFIXES):  # most words have none: one call tells
        n = len(w) - 2
        for s in K.SUFFIXES:
            if len(s) < n and w.endswith(s):
                return w[: -len(s)]
    return w


class _Stems(dict):
    """The stem of a word as it is written; None for a stop word or one of under three letters."""

    def __missing__(self, w: str) -> str | None:
        low = w.lower()
        out = None if len(low) < 3 or low in K.QUERY_STOP else stem_py(low)
        if len(self) < KNOWN:
            self[w] = out
        return out


class _Again(dict):
    """A term stemmed once more, None if that is the same."""

    def __missing__(self, term: str) -> str | None:
        if len(self) >= KNOWN:
            self.clear()
        out = stem_py(term)
        self[term] = out = None if out == term else out
        return out


def _counted(batches):
    """The rows of doc_words from path, body, parts."""
    import pyarrow as pa

    find, stems, twice = re.compile(K.WORD).findall, _Stems(), _Again()
    text = pa.string()

    def offsets(sizes) -> pa.Array:
        return pa.array([0, *accumulate(sizes)], pa.int32())

    def lists(rows: list[list], kind) -> pa.Array:
        return pa.ListArray.from_arrays(offsets(map(len, rows)), pa.array(list(chain.from_iterable(rows)), kind))

    for b in batches:
        for at in range(0, len(b), 512):
            some = b.slice(at, 512)
            heads, each = some.column("parts").flatten(), some.column("parts").value_lengths().to_pylist()
            titles = heads.field("heading")
            found = iter([[(w, t) for w in find(h) if (t := stems[w]) is not None] for h in titles.to_pylist()])
            length, terms, counts, marks, more, words, of = [], [], [], [], [], [], []
            for body, size in zip(some.column("body").to_pylist(), each):
                n = Counter(map(stems.__getitem__, find(body)))
                n.pop(None, None)
                length.append(n.total())
                marked = set()
                for kept in islice(found, size):
                    words.append([w.lower() for w, _ in kept])
                    of.append(here := [t for _, t in kept])
                    marked.update(here)
                keys = [*n, *sorted(marked - n.keys())]
                terms.append(keys)
                counts.append([n[t] for t in keys])
                marks.append([t in marked for t in keys])
                more.append([twice[t] for t in keys])
            rows = pa.StructArray.from_arrays([heads.field("line_start"), heads.field("level"), titles, lists(words, text), lists(of, text)], names=["line", "level", "text", "words", "terms"])
            yield pa.RecordBatch.from_arrays(
                [some.column("path"), pa.array(length, pa.int64()), lists(terms, text), lists(counts, pa.int32()), lists(marks, pa.bool_()), lists(more, text), pa.ListArray.from_arrays(offsets(each), rows)],
                names=["path", "doc_length", "terms", "counts", "in_heading", "again", "heads"],
            )


@stored
def doc_words(docs: DataFrame) -> DataFrame:
    """A row for each document, from its own text: path, doc_length, its keywords (terms; counts, 0 for one that only a heading has; in_heading; again: stemmed once more, null if that is the same), heads (line, level, text, words, terms).

    path is the key of docs."""
    from . import structure

    prose = F.array_join(F.filter("l", lambda x: ~(x.startswith("```") | x.startswith("    "))), "\n")
    return structure.parts_of(docs).select("path", prose.alias("body"), "parts").mapInArrow(_counted, _WORDS)


def words_of(docs: DataFrame, paths: list[str]) -> DataFrame:
    """doc_words of a few documents, from their texts."""
    return doc_words(docs.where(F.col("path").isin(*paths)))


@view
def term_freq(docs: DataFrame) -> DataFrame:
    return weights(docs).select("path", "term", "tf")


def weights(docs: DataFrame) -> DataFrame:
    """path, doc_length, term, tf."""
    x = doc_words(docs).select("path", "doc_length", F.inline(F.arrays_zip("terms", "counts")).alias("term", "tf"))
    return x.where("tf > 0").withColumn("tf", F.col("tf").cast("long"))


@view
def doc_length(docs: DataFrame) -> DataFrame:
    """path, doc_length, with a row for documents without words as well."""
    return doc_words(docs).select("path", "doc_length")


def corpus_stats(docs: DataFrame) -> DataFrame:
    return doc_length(docs).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"))


def idf(docs: DataFrame) -> DataFrame:
    """term, df, idf; the count of documents is one row, joined to all."""
    df = term_freq(docs).groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    value = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.1))
    return df.crossJoin(n).select("term", "df", value.alias("idf"))


@view
def headings(docs: DataFrame) -> DataFrame:
    """path, line, level, text."""
    from . import structure

    return structure.spans(docs).select("path", F.col("line_start").alias("line"), "level", F.col("heading").alias("text"))


@view
def keyword_sets(docs: DataFrame) -> DataFrame:
    """path, term, in_heading: the terms of the headings, and those of the body that are in none."""
    return doc_words(docs).select("path", F.inline(F.arrays_zip("terms", "in_heading")).alias("term", "in_heading"))


@view
def postings(docs: DataFrame) -> DataFrame:
    """term, path, line, heading, level: keywords (stemmed once more), and each word of each heading."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("line", "int"), ("heading", "string"), ("level", "int"))]
    x = doc_words(docs)
    keywords = x.select("path", F.inline(F.arrays_zip("terms", "again")).alias("term", "again")).select(F.coalesce("again", "term").alias("term"), "path", *none)
    found = x.select("path", F.inline("heads")).select(F.explode("terms").alias("term"), "path", "line", F.col("text").alias("heading"), "level")
    return keywords.unionByName(found)


def term_stats(docs: DataFrame, full: bool = True) -> DataFrame:
    """term, postings, docs of the postings, each document's row at a time; full: first_path, and how the term is written: s1 (path, line, idx, word) where it first
    stands in a heading, s2 (path, value) the first keyword by path and value that is stemmed to it.

    A task adds up its documents' terms before they are shuffled, at most MOST at once."""
    extra = "s1 struct<path: string, line: int, idx: int, word: string>, s2 struct<path: string, value: string>"
    schema = "term string, postings long, docs long" + (f", first_path string, {extra}" if full else "")

    def run(batches):
        import pyarrow as pa

        acc: dict[str, list] = {}
        s1 = pa.struct([("path", pa.string()), ("line", pa.int32()), ("idx", pa.int32()), ("word", pa.string())])
        s2 = pa.struct([("path", pa.string()), ("value", pa.string())])
        kinds = [pa.string(), pa.int64(), pa.int64(), *([pa.string(), s1, s2] if full else [])]

        def flush():
            rows = list(acc.items())
            acc.clear()
            for at in range(0, len(rows), 10_000):
                some = rows[at : at + 10_000]
                cols = [[t for t, _ in some], [v[0] for _, v in some], [v[1] for _, v in some]]
                if full:
                    cols += [[v[2] for _, v in some], [v[3] and dict(zip(("path", "line", "idx", "word"), v[3])) for _, v in some], [v[4] and {"path": v[4][0], "value": v[4][1]} for _, v in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["term", "postings", "docs", "first_path", "s1", "s2"][: len(cols)])

        for b in batches:
            for at in range(0, len(b), 512):
                some = b.slice(at, 512)
                for path, terms, again, heads in zip(*(some.column(c).to_pylist() for c in ("path", "terms", "again", "heads"))):
                    here = Counter(a or t for t, a in zip(terms, again))
                    for h in heads:
                        here.update(h["terms"])
                    for t, n in here.items():
                        v = acc.get(t)
                        if v is None:
                            acc[t] = [n, 1, path, None, None]
                        else:
                            v[0] += n
                            v[1] += 1
                            if path < v[2]:
                                v[2] = path
                    if full:
                        for t, a in zip(terms, again):
                            v = acc[a or t]
                            if v[4] is None or (path, t) < v[4]:
                                v[4] = (path, t)
                        for h in heads:
                            for i, (w, t) in enumerate(zip(h["words"], h["terms"])):
                                if acc[t][3] is None or (path, h["line"], i, w) < acc[t][3]:
                                    acc[t][3] = (path, h["line"], i, w)
                    if len(acc) >= MOST:
                        yield from flush()
        yield from flush()

    part = doc_words(docs).select("path", "terms", "again", "heads").mapInArrow(run, schema)
    if full:
        part = part.where(T.hygienic(F.col("term")))
        return part.groupBy("term").agg(F.sum("postings").alias("postings"), F.sum("docs").alias("docs"), *[F.min(c).alias(c) for c in ("first_path", "s1", "s2")])
    return part.groupBy("term").agg(F.sum("postings").alias("postings"), F.sum("docs").alias("docs"))


def postings_count(docs: DataFrame) -> DataFrame:
    return term_stats(docs, full=False)


def top_keywords(docs: DataFrame, n: int = 20) -> DataFrame:
    return term_stats(docs, full=False).select("term", "postings").orderBy(F.desc("postings"), "term").limit(n)


@stored
def links(docs: DataFrame) -> DataFrame:
    """path, line, nth, text, target of each Markdown link, images too."""
    rx = F.lit(LINK)
    at = lines(docs).where(F.col("line").contains("]("))
    both = F.arrays_zip(F.regexp_extract_all("line", rx, F.lit(1)).alias("text"), F.regexp_extract_all("line", rx, F.lit(2)).alias("target"))
    return at.select("path", F.col("line_no").alias("line"), F.posexplode(both).alias("nth", "x")).select("path", "line", "nth", "x.text", "x.target")


def index_stats(docs: DataFrame) -> DataFrame:
    terms = term_stats(docs, full=False).agg(F.count("*").alias("terms"))
    h = headings(docs).agg(F.count("*").alias("headings"))
    k = links(docs).agg(F.count("*").alias("links"))
    return docs.agg(F.count("*").alias("files")).crossJoin(terms).crossJoin(h).crossJoin(k)


@stored
def adr_refs(docs: DataFrame) -> DataFrame:
    """path, line, nth, raw_text, normalized_id of each mention of a decision record."""
    rx = r"\bADR[-_ ]?(\d{2,4})\b"
    at = lines(docs).where(F.col("line").contains("ADR"))
    found = at.select("path", F.col("line_no").alias("line"), F.posexplode(F.regexp_extract_all("line", F.lit(rx), F.lit(0))).alias("nth", "raw_text"))
    number = F.regexp_extract("raw_text", rx, 1).cast("int").cast("string")
    return found.withColumn("normalized_id", F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
