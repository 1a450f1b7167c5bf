"""Repeated passages: suffix arrays by two-stage sorting, over all documents.

A passage of at least `least` words that occurs twice (in two documents, or apart from itself
in one) is found wherever it is.  Texts are compared as lower-case words.

1. Every run of `least` words has one anchor, its 8-word gram with the smallest hash (the
   leftmost of equals), so equal runs have equal anchors.  Anchors that occur once anywhere
   can't belong to a repeat; they drop out by an exact count over all documents.
2. Of the other anchors, the words of all runs that have them (a context: the runs are next to each other) go
   to one task by the anchor's hash, so all copies of a run meet.
3. There the contexts' suffix array is built by two-stage sorting: suffixes that are smaller
   than their successors are sorted directly, the others are induced by one scan over the buckets;
   common prefixes of adjacent suffixes then give the intervals of equal runs.
4. Runs next to each other are joined to passages again.

The occurrence with the smallest (doc_id, position) is the first of its run; a later one that
overlaps the first, in a text that repeats itself, doesn't count.

Defined results: null, empty and shorter texts have no passages; equal rows (doc_id and text)
are one document; a null doc_id comes last; very long texts are read whole; an empty table gives no rows; extra columns are ignored by repeated() and
carried along by drop_passages().  doc_id must be a number or a text of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tokens import char_offsets, grams, slices, words
from ._util import discard, fresh, materialize

LEAST, GRAM = 50, 8
FLUSH_WORDS = 1 << 20
_LAST = (1 << 63) - 1  # stands for a null doc_id, which comes last


# --- anchors ----------------------------------------------------------------------------


def contexts(h: np.ndarray, of: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, document, first word and end of each context of the documents' words h."""
    none = np.zeros(0, np.int64)
    size = np.diff(of)
    n, span = len(h), least - gram + 1
    g = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    value, first, _ = grams(h, of, gram)
    g[first] = value
    starts = np.flatnonzero(np.repeat(of[1:], size) - np.arange(n) >= least)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    # the smallest gram of a window of span, the leftmost of equals, by doubling
    low, where, k = g, np.arange(n), 1

    def smaller(x: slice, y: slice) -> tuple[np.ndarray, np.ndarray]:
        right = low[y] < low[x]
        return np.where(right, low[y], low[x]), np.where(right, where[y], where[x])

    while 2 * k <= span:
        low, where = smaller(slice(None, len(low) - k), slice(k, None))
        k *= 2
    right = low[starts + span - k] < low[starts]
    at = np.where(right, where[starts + span - k], where[starts])
    doc = np.repeat(np.arange(len(size)), size)[starts]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1) | (np.diff(doc) != 0)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]])
    return g[at[lo]], doc[lo], starts[lo], starts[hi - 1] + least


def anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """anchor, node, ord for each context of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                w = words(b.column("text")[i:j])
                a, doc, start, _ = contexts(w.hash, w.of, least, gram)
                if len(a):
                    take = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b.column("node").take(take), pa.array(start - w.of[doc])], names=["anchor", "node", "at"])

    return docs.select("node", "text").mapInArrow(run, "anchor long, node long, at long")


def passages_of(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """docs (doc, node, text, wanted anchors) as the contexts of the wanted anchors: anchor, doc, node, at, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                w = words(b.column("text")[i:j])
                h = w.hash
                a, doc, start, end = contexts(h, w.of, least, gram)
                if not len(a):
                    continue
                want = b.column("wanted")[i:j]
                wanted = want.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(j - i), np.diff(want.offsets.to_numpy()))
                ok = np.isin(a * np.uint64(31) + doc.astype(np.uint64), wanted * np.uint64(31) + owner.astype(np.uint64))
                a, doc, start, end = a[ok], doc[ok], start[ok], end[ok]
                if len(a):
                    short = (h >> np.uint64(32)).astype("<u4")
                    take = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), b.column("doc").take(take), b.column("node").take(take), pa.array(start - w.of[doc]), pa.array([short[x:y].tobytes() for x, y in zip(start, end)], pa.binary())],
                        names=["anchor", "doc", "node", "at", "words"],
                    )

    return docs.select("doc", "node", "text", "wanted").mapInArrow(run, "anchor long, doc long, node long, at long, words binary")


# --- suffix array -----------------------------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of the symbols t (0 and up; the last must occur only there), by two-stage sorting."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    # type B: smaller than its successor; equal symbols are as the next that differs
    d = np.sign(np.diff(t))
    idx = np.where(d != 0, np.arange(n - 1), n - 2)
    nxt = np.minimum.accumulate(idx[::-1])[::-1]
    is_b = np.append(d[nxt] > 0, False)
    b = np.flatnonzero(is_b)
    order = _sort(t, b)
    count = np.bincount(t)
    end = np.cumsum(count)
    sa = np.full(n, -1, np.int64)
    sym = t[order]
    nb = np.bincount(sym, minlength=len(count))
    before = np.cumsum(nb) - nb
    sa[end[sym] - nb[sym] + np.arange(len(order)) - before[sym]] = order
    # one scan from the left places each other suffix, just before its successor is passed, at its bucket's front
    head = (end - count).tolist()
    out, sy, kind = sa.tolist(), t.tolist(), is_b.tolist()
    # the last suffix has no successor: it is the first of its bucket
    out[head[sy[-1]]] = n - 1
    head[sy[-1]] += 1
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and not kind[j]:
            c = sy[j]
            out[head[c]] = j
            head[c] += 1
    return np.array(out, np.int64)


def _sort(t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The suffixes b in order, comparing a few symbols at a time; only what is still tied goes on."""
    n = len(t)
    bits = int(t.max() + 1).bit_length()
    step = max(1, 62 // bits)
    ext = np.concatenate([t + 1, np.zeros(step, t.dtype)]).astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for k in range(step):
        packed = (packed << np.uint64(bits)) | ext[k : n + k]
    order = b[np.argsort(packed[b], kind="stable")]
    key = packed[order]
    same = np.concatenate([[False], key[1:] == key[:-1]]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(~same)
    off = step
    live = np.flatnonzero(same | np.append(same[1:], False)) if len(order) else np.zeros(0, np.int64)
    while len(live):
        at = order[live] + off
        k = np.where(at < n, packed[np.minimum(at, n - 1)], np.uint64(0))
        g = group[live]
        o = np.lexsort((k, g))
        order[live] = order[live][o]
        k = k[o]
        tied = np.concatenate([[False], (k[1:] == k[:-1]) & (g[1:] == g[:-1])])
        ng = np.cumsum(~tied)
        keep = tied | np.append(tied[1:], False)
        group[live] = ng
        live = live[keep]
        off += step
    return order


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in sa; the first has 0."""
    n = len(t)
    lcp = np.zeros(n, np.int64)
    live, k = np.arange(1, n), 0
    while len(live):
        a, b = sa[live] + k, sa[live - 1] + k
        ok = (a < n) & (b < n)
        ok[ok] = t[a[ok]] == t[b[ok]]
        live = live[ok]
        lcp[live] += 1
        k += 1
    return lcp


def equal_runs(cols: list[np.ndarray], texts: list[bytes], least: int) -> list[np.ndarray]:
    """doc, node, start, end, first of the runs that repeat among contexts (doc, node, at) with these words."""
    doc, node, at = cols
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(x, len(known)) for x in texts])
    size = np.array([len(x) // 4 for x in known])
    flat = np.frombuffer(b"".join(known), "<u4")
    _, sym = np.unique(flat, return_inverse=True)
    c = len(known)
    begin = np.cumsum(size + 1) - size - 1
    t = np.empty(len(flat) + c, np.int64)
    ends = begin + size
    is_end = np.zeros(len(t), bool)
    is_end[ends] = True
    t[~is_end] = sym + c
    t[is_end] = np.arange(c)[::-1]  # each its own symbol; the last is the smallest
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa)
    ctx = np.searchsorted(begin, sa, "right") - 1
    off = sa - begin[ctx]
    interval = np.cumsum(lcp < least)
    long = size[ctx] - off >= least
    ctx, off, interval = ctx[long], off[long], interval[long]
    # to each run of a distinct context, the contexts that are equal to it
    by = np.argsort(which, kind="stable")
    many = np.bincount(which, minlength=c)
    start = np.cumsum(many) - many
    reps = many[ctx]
    row = by[np.repeat(start[ctx], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
    interval, pos = np.repeat(interval, reps), at[row] + np.repeat(off, reps)
    d, x = doc[row], node[row]
    o = np.lexsort((pos, x, d, interval))
    interval, pos, d, x = interval[o], pos[o], d[o], x[o]
    lead = np.concatenate([[True], interval[1:] != interval[:-1]]) if len(interval) else np.zeros(0, bool)
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(interval) else np.zeros(0, np.int64)
    own = (d == d[head]) & (x == x[head])
    copy = ~lead & ~(own & (pos < pos[head] + least))
    leads = np.zeros(len(interval), bool)
    leads[head[copy]] = True
    keep = copy | leads
    d, x, pos, lead = d[keep], x[keep], pos[keep], lead[keep]
    # runs next to each other
    o = np.lexsort((pos, lead, x, d))
    d, x, pos, lead = d[o], x[o], pos[o], lead[o]
    if not len(d):
        return [d, x, pos, pos, lead]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (lead[1:] != lead[:-1]) | (pos[1:] > pos[:-1] + least)])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(d)) - 1
    return [d[a], x[a], pos[a], pos[z] + least, lead[a]]


def repeated(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word, n_words, is_first: the passages that occur more than once."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("node"), F.col("text"))
    found = materialize(anchors(base, least, gram))
    twice = found.dropDuplicates(["anchor", "node", "at"]).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = found.join(twice, "anchor", "left_semi").groupBy("node").agg(F.collect_set("anchor").alias("wanted"))
    some = materialize(wanted)
    full = base.join(some.hint("shuffle_hash"), "node")
    ctx = passages_of(full, least, gram).repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            rows = sorted({*zip(*(t.column(c).to_pylist() for c in ("doc", "node", "at", "words")))}) if len(t) else []
            if len(rows) > 1:
                cols = [np.array([r[k] for r in rows], np.int64) for k in range(3)]
                d, x, a, z, lead = equal_runs(cols, [r[3] for r in rows], least)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(x), pa.array(a), pa.array(z), pa.array(lead)], names=["doc", "node", "a", "z", "is_first"])

        held, words_held = [], 0
        for b in batches:
            anchor = b.column("anchor").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(anchor)) + 1
            if held and len(anchor) and held[-1].column("anchor")[-1].as_py() != anchor[0]:
                edges = np.concatenate([[0], edges])
            lo = 0
            for e in edges.tolist():
                if words_held + (e - lo) * 80 >= FLUSH_WORDS:
                    yield from flush([*held, b[lo:e]] if e > lo else held)
                    held, words_held, lo = [], 0, e
            if lo < len(b):
                held.append(b[lo:])
                words_held += (len(b) - lo) * 80
        if held:
            yield from flush(held)

    spans = ctx.mapInArrow(run, "doc long, node long, a long, z long, is_first boolean")
    w = W.partitionBy("doc", "node", "is_first").orderBy("a", "z")
    reach = F.max("z").over(w.rowsBetween(W.unboundedPreceding, -1))
    joined = spans.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    out = joined.groupBy("doc", "node", "is_first", "island").agg(F.min("a").alias("start_word"), F.max("z").alias("end_word"))
    out = out.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "node", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "is_first")
    out = materialize(out)
    discard(found, some)
    return out


def drop_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs with the later copies of repeated passages deleted from text; what is not words between two of them goes with them."""
    node, cuts = fresh(docs, "node", "cuts")
    later = repeated(docs.select("doc_id", "text"), least, gram).where("not is_first")
    marks = later.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts)).withColumnRenamed("node", node)

    @F.pandas_udf("string")
    def without(text: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([_without(t, [(c["start_word"], c["end_word"]) for c in x]) for t, x in zip(text, cut)])

    joined = docs.withColumn(node, F.xxhash64("doc_id", "text")).join(marks.hint("shuffle_hash"), node, "left")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    same, edited = joined.where(F.col(cuts).isNull()), joined.where(F.col(cuts).isNotNull())
    return same.select(*cols).unionByName(edited.withColumn("text", without("text", cuts)).select(*cols))


def _without(text: str, cuts: list[tuple[int, int]]) -> str:
    """text without some runs of words [a, z)."""
    w = words(pa.array([text], pa.string()))
    out, at = [], 0
    for a, z in cuts:
        start, end = char_offsets(w.data, 0, np.array([w.start[a], w.end[z - 1]]))
        out.append(text[at : max(at, start)])
        at = max(at, end)
    return "".join([*out, text[at:]])


def brute_force(rows: list[tuple], least: int) -> set[tuple]:
    """(doc_id, word, is_first) of each word of a repeated run, by a dictionary of all runs; for tests."""
    runs: dict[tuple, list] = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        h = (words(pa.array([t], pa.string())).hash >> np.uint64(32)).tolist()
        for i in range(len(h) - least + 1):
            runs.setdefault(tuple(h[i : i + least]), []).append((d, t, i))
    out = set()
    for occ in runs.values():
        first = occ[0]
        later = [o for o in occ[1:] if o[:2] != first[:2] or o[2] >= first[2] + least]
        for o in later and [first, *later]:
            out |= {(o[0], o[2] + k, o is first) for k in range(least)}
    return out
