"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Seeds are runs of `n` words that a document shares with a test item; every one counts, however
many documents it is in.  Around each cluster of seeds the document's
words (with a margin of the longest item on both sides) are aligned with the item's;
the score of the best local alignment, divided by that of the item with itself, must reach `threshold`.
A region that lacks too many of the item's words to reach it isn't aligned: each word of the item adds at most a match.

One pass over the documents: a bit map of the items' seeds, of 16 bits and more for each up to `MOST_BITS` (128 MB to every
executor, enough for 67 million seeds; beyond, more other runs come through to the join), lets few other runs through; the exact join is a shuffle join on the seed.

Defined results: null or empty texts and items of fewer than n words match nothing; repeated documents or
items give one row per (doc_id, item_id), with the best score; a null in
doc_id is a value like others, an item without item_id is left out; very long texts are read whole; of equal scores the earliest passage is given;
empty tables give no rows; extra columns are carried along by drop_contaminated().  doc_id and item_id must be numbers or texts of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tokens import grams, slices, words
from ._util import discard, fresh, materialize, own

N, THRESHOLD = 4, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BITS, MOST_BITS = 1 << 23, 1 << 30


def items_of(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, node (hash of the text), words (little-endian uint32), seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column("text"))
            h = w.hash
            g, _, at = grams(h, w.of, n)
            for d in range(len(b)):
                lo, hi = w.of[d], w.of[d + 1]
                if hi - lo >= n:
                    yield pa.RecordBatch.from_arrays(
                        [b.column("item_id")[d : d + 1], pa.array([h[lo:hi].astype("<u4").tobytes()], pa.binary()), pa.array([int(hi - lo)], pa.int32()), pa.array([np.unique(g[at[d] : at[d + 1]]).view(np.int64).tolist()], pa.list_(pa.int64()))],
                        names=["item_id", "item", "size", "seeds"],
                    )

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, item binary, size int, seeds array<long>")


def bit_map(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """The seeds' hashes modulo bits, as packed bits; each task sends its own, of one fixed size."""

    n = seeds.count()
    while bits < MOST_BITS and bits < 16 * n:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(bits, bool)
        for b in batches:
            m[b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) % np.uint64(bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(m).tobytes()], pa.binary())], names=["m"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                m |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    parts = seeds.coalesce(8).mapInArrow(run, "m binary").coalesce(1).mapInArrow(both, "m binary").first()
    return np.frombuffer(parts.m, np.uint8) if parts else np.zeros(bits // 8, np.uint8)


def regions(docs: DataFrame, known: np.ndarray, n: int, margin: int) -> DataFrame:
    """doc_id, node, region (the words around a cluster of seeds), seeds within it: for every document."""
    bits = len(known) * 8
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = sent.value
        for b in batches:
            text = b.column("text")
            for i, j in slices(text):
                w = words(text[i:j])
                h = w.hash
                g, first, _ = grams(h, w.of, n)
                at = g % np.uint64(bits)
                hit = np.flatnonzero(bit[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                if not len(hit):
                    continue
                g, first = g[hit], first[hit]
                doc = w.doc_of()[first]
                cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(first) > margin)) + 1
                lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(g)]])
                a = np.maximum(w.of[doc[lo]], first[lo] - margin)
                z = np.minimum(w.of[doc[lo] + 1], first[hi - 1] + n + margin)
                take = pa.array(doc[lo] + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(take),
                        b.column("node").take(take),
                        pa.array(a - w.of[doc[lo]], pa.int64()),
                        pa.array([h[x:y].astype("<u4").tobytes() for x, y in zip(a, z)], pa.binary()),
                        pa.array([np.unique(g[x:y]).view(np.int64).tolist() for x, y in zip(lo, hi)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "node", "at", "region", "seeds"],
                )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), "text")
    return base.mapInArrow(run, "doc_id long, node long, at long, region binary, seeds array<long>")


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of a (item) with b (region): score, and the first and last matched word of b.

    Row by row; the gap along a row is a running maximum, so each row is a few array operations."""
    m = len(b)
    col = np.arange(1, m + 1)
    prev, ps = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, span = 0, (0, 0)
    for x in a:
        diag = prev[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = prev[1:] + GAP
        take = diag >= up
        v = np.where(take, diag, up)
        s = np.where(take, ps[:-1], ps[1:])
        empty = v <= 0
        v[empty] = 0
        s[empty] = col[empty]
        # gaps along the row: v[j] = max over i <= j of v[i] + GAP * (j - i)
        lifted = v - GAP * col
        run = np.maximum.accumulate(lifted)
        where = np.maximum.accumulate(np.where(lifted == run, np.arange(m), 0))
        v = run + GAP * col
        s = s[where]
        prev = np.concatenate([[0], v])
        ps = np.concatenate([[0], s])
        k = int(v.argmax())
        if v[k] > best:
            best, span = int(v[k]), (int(s[k]), k)
    return best, *span


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, item_id, score, first_word, last_word of the document's best passage for each item found."""
    items = materialize(items_of(own(benchmark, "item_id", "text"), n))
    longest = items.agg(F.max("size")).first()[0] or 0
    seeds = items.select("item_id", F.explode("seeds").alias("seed"))
    found = materialize(regions(docs, bit_map(seeds.select("seed")), n, longest))
    hits = found.select("node", "at", F.explode("seeds").alias("seed"))
    pairs = hits.join(seeds.select("seed", "item_id").distinct(), "seed").select("node", "at", "item_id")
    # equal documents are aligned once
    one = pairs.distinct()
    texts = found.select("node", "at", "region").dropDuplicates(["node", "at"])
    full = one.join(texts, ["node", "at"]).join(items.select("item_id", "item").distinct(), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for r in p.itertuples():
                a, b = np.frombuffer(r.item, "<u4"), np.frombuffer(r.region, "<u4")
                if np.isin(a, b).sum() < threshold * len(a):
                    continue
                s, lo, hi = align(a, b)
                out.append((r.node, r.item_id, s / (MATCH * len(a)), r.at + lo, r.at + hi))
            yield pd.DataFrame(out, columns=["node", "item_id", "score", "first_word", "last_word"])

    scored = full.select("node", "at", "item_id", "region", "item").mapInPandas(run, "node long, item_id long, score double, first_word long, last_word long").where(F.col("score") >= threshold)
    best = scored.groupBy("node", "item_id").agg(F.max(F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("b"))
    best = materialize(best.select("node", "item_id", "b.score", (-F.col("b.col2")).alias("first_word"), (-F.col("b.col3")).alias("last_word")))
    ids = found.select("doc_id", "node").distinct()
    out = materialize(ids.join(best, "node").select("doc_id", "node", "item_id", F.round("score", 6).alias("score"), "first_word", "last_word"))
    discard(items, found, best)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """docs without the contaminated ones."""
    (node,) = fresh(docs, "node")
    bad = contaminated(docs, benchmark, **params).select(F.col("node").alias(node)).distinct()
    return docs.withColumn(node, F.xxhash64("text")).join(bad.hint("shuffle_hash"), node, "left_anti").drop(node)


def brute_force(docs: list[tuple], items: list[tuple], threshold: float = THRESHOLD) -> set[tuple]:
    """(doc_id, item_id) by aligning every item with every whole text; for tests."""
    out = set()
    for d, t in docs:
        b = words(pa.array([t], pa.string())).hash.astype("<u4")
        for i, u in items:
            a = words(pa.array([u], pa.string())).hash.astype("<u4")
            if len(a) >= N and len(b) and align(a, b)[0] / (MATCH * len(a)) >= threshold:
                out.add((d, i))
    return out
