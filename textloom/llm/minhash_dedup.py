"""Near-duplicate documents: MinHash, banding, verified signatures, star components.

Each text gives the minima of `perms` universal (multiply-shift) hashes over its runs of
`shingle` words; texts that agree in a band of `rows` minima are candidates; a pair whose
signatures agree in `threshold` of their slots is an edge; connected components come from
alternating large-star and small-star.

Candidates of a band bucket are first compared with the bucket's smallest member only.
A bucket that this leaves in several components has all its pairs across components compared
as well, block by block, so the components are those of all-pairs comparison, no bucket is capped and none is one task.

A key with a large share of the rows (a bucket, a root, a text with many copies) is never sorted or joined in
one task: its totals come from aggregates and go to its rows by a broadcast of the few such keys.

Defined results: a null, empty or wordless text is never a duplicate; texts that are equal
are one node, so repeated rows are duplicates of each other; of each group the row
with the smallest doc_id stays (null last), and one of several equal rows; very long texts are read whole; empty tables give none;
extra columns are carried along.  doc_id must be a number or a text of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _util
from ._tokens import grams, slices, words
from ._util import discard, fresh, materialize, own, spread_join

PERMS, ROWS, SHINGLE, THRESHOLD = 160, 4, 3, 0.5
BLOCK = 512  # members of a bucket that are compared with as many at once


def _hashes(perms: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, perms), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signature_matrix(arr: pa.Array, perms: int, shingle: int) -> np.ndarray:
    """uint32 minima, one row for each text; texts without words have the largest value throughout."""
    a, b = _hashes(perms)
    w = words(arr)
    x, _, at = grams(w.hash, w.of, shingle, whole_if_short=True)
    x >>= np.uint64(32)
    out = np.full((len(arr), perms), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        # blocks of whole texts that stay in cache
        cuts = np.unique(np.searchsorted(at[some], np.arange(0, len(x), 1 << 14), "left"))
        cuts = np.append(cuts[cuts < len(some)], len(some))
        cuts = np.unique(np.append(0, cuts))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            d = some[lo:hi]
            base = at[d[0]]
            block = x[base : at[d[-1] + 1]]
            h = np.empty_like(block)
            for k in range(perms):
                np.multiply(block, a[k], out=h)
                h += b[k]
                out[d, k] = np.minimum.reduceat(h, at[d] - base) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, perms: int = PERMS, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """node (hash of the text), doc_id, sig (little-endian uint32 minima) of the documents with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            for i, j in slices(col):
                m = signature_matrix(col[i:j], perms, shingle)
                rows = np.flatnonzero((m != 0xFFFFFFFF).any(axis=1))
                take = pa.array(rows + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(take), batch.column("doc_id").take(take), pa.array([m[r].astype("<u4").tobytes() for r in rows], pa.binary())],
                    names=["node", "doc_id", "sig"],
                )

    base = docs.select(F.xxhash64(f"`{text}`").alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return base.mapInArrow(run, "node long, doc_id long, sig binary")


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, sa, sb) as (a, b, similarity): the share of equal slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if len(t):
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u4").reshape(len(t), -1) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array((x == y).mean(axis=1))], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the undirected edges (a, b); root is the component's smallest node.

    Alternates large-star (each node's larger neighbours point to its smallest neighbour) and
    small-star (its smaller ones do), until the edges don't change; each round is written to
    the shared folder.  A node's smallest neighbour comes from an aggregate, not from a sort of all of its neighbours, so the root
    of a component with a third of all nodes is no large task.  Self-loops and repeated edges do nothing."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1000000007).cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == state or not now.n:
            break
        state = (now.n, now.s)
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        written = materialize if now.n > _util.FLOOR else lambda df: df  # a small graph is cheaper to derive twice
        large = written(spread_join(both, least, "u", 2 * now.n).select("u", "v", F.least("u", "m").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # after large-star a node has at most as many smaller neighbours as edges led to it from smaller ones
        small = spread_join(large, large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", now.n).select("u", "v", "m")
        new = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        old, e = e, materialize(new)
        discard(old, large)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = materialize(roots.union(roots.select("root", "root").distinct()))
    discard(e)
    return out


def band_keys(sigs: DataFrame, perms: int, rows: int) -> DataFrame:
    bands = [F.xxhash64(F.lit(i), F.substring("sig", 4 * rows * i + 1, 4 * rows)) for i in range(perms // rows)]
    return sigs.select("node", F.explode(F.array(*bands)).alias("key"))


def _crossed(split: DataFrame, sig: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between members of one bucket that are alike but in different components; split holds (key, node, root).

    A bucket's members are dealt into blocks, and every two blocks are a task's row group of at most twice `block` members, compared as arrays; of
    the alike ones, edges that connect them are given, not all pairs."""
    size = split.groupBy("key").agg(F.count("*").alias("n"))
    of = F.ceil(F.col("n") / block).cast("int")
    dealt = spread_join(split, size, "key", split.count()).withColumn("of", of).withColumn("i", F.pmod(F.xxhash64("node"), of).cast("int"))
    # block i meets block j in the group (smaller, larger)
    pair = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    members = dealt.join(sig, "node").select("key", "node", "root", "sig", F.explode(pair).alias("g")).select("key", "g.lo", "g.hi", "node", "root", "sig")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m = np.frombuffer(b"".join(p["sig"]), "<u4").reshape(len(p), -1)
        node, root = p["node"].to_numpy(), p["root"].to_numpy()
        out, of = [], {int(r): int(r) for r in root}

        def find(x: int) -> int:
            while of[x] != x:
                of[x] = of[of[x]]
                x = of[x]
            return x

        for i in range(len(p) - 1):
            for j in i + 1 + np.flatnonzero((m[i + 1 :] == m[i]).mean(axis=1) >= threshold):
                x, y = find(int(root[i])), find(int(root[j]))
                if x != y:
                    of[max(x, y)] = min(x, y)
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return members.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def groups(docs: DataFrame, perms: int = PERMS, rows: int = ROWS, shingle: int = SHINGLE, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """node, root, doc_id, row (a number of its own) of the documents that have a near or exact duplicate."""
    sigs = materialize(signatures(docs, perms, shingle, text))
    nodes = materialize(sigs.groupBy("node").agg(F.first("sig").alias("sig"), F.count("*").alias("copies")))
    keys = materialize(band_keys(nodes, perms, rows))
    buckets = materialize(keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    some = nodes.count()
    keyed = materialize(spread_join(keys, buckets, "key", some * (perms // rows)).select("node", "key", "lead"))
    sig = nodes.select("node", "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
        return agreement(full).where(F.col("similarity") >= threshold).select("a", "b")

    edges = materialize(verified(keyed.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()))
    comp = components(edges)
    root = materialize(keyed.join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    # copies share many buckets: of buckets with the same members one is compared
    all_of = [F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")]
    mixed = root.groupBy("key").agg(*all_of).where("lo <> hi").groupBy("lo", "hi", "n", "members").agg(F.min("key").alias("key")).select("key", "n")
    split = materialize(spread_join(root, mixed, "key", some * (perms // rows)).select("key", "node", "root"))
    more = materialize(_crossed(split, sig, threshold))
    if not more.isEmpty():
        # what is known already is a forest of stars, which takes few rounds
        comp, old = components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), comp
        discard(old)
    alike = nodes.where("copies > 1").select("node")
    found = materialize(comp.select("node", "root").unionByName(alike.join(comp, "node", "left_anti").select("node", F.col("node").alias("root"))).join(nodes.select("node", F.col("copies").alias("n")), "node"))
    out = materialize(spread_join(sigs.select("node", "doc_id"), found, "node", sigs.count()).select("node", "root", "doc_id", F.monotonically_increasing_id().alias("row")))
    discard(sigs, nodes, keys, buckets, keyed, edges, comp, root, split, more, found)
    return out


def _firsts(g: DataFrame) -> DataFrame:
    """root, n, first (the row that stays: of the smallest doc_id, null last) of each group."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node", "row"))
    return g.groupBy("root").agg(F.count("*").alias("n"), first.alias("first"))


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """doc_id, group_id (the group's smallest doc_id, the one that stays), group_size, keep: all members of groups."""
    g = groups(docs, **params)
    all_ = spread_join(g, _firsts(g), "root", g.count())
    return all_.select("doc_id", F.col("first.doc_id").alias("group_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", **params) -> DataFrame:
    """docs without all but one document of each group; all columns are kept."""
    g = groups(docs, text=text, **params)
    # one row for each text of a group: its copies, and the doc_id that stays if it is this text's
    stay = _firsts(g).select(F.col("first.node").alias("node"), F.struct(F.col("first.doc_id").alias("id")).alias("stays"))
    verdict = materialize(g.groupBy("node").agg(F.count("*").alias("n")).join(stay, "node", "left"))
    node, stays, n, id_ = fresh(docs, "node", "stays", "n", "id")
    total = verdict.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bound = max(1000, total // 10_000)  # a text with more copies is one of at most 10,000
    named = verdict.select(F.col("node").alias(node), F.col("n").alias(n), F.col("stays").alias(stays))
    hot, cold = F.broadcast(named.where(F.col(n) > bound)), named.where(F.col(n) <= bound)
    rows = docs.withColumn(node, F.xxhash64(f"`{text}`")).withColumn(id_, F.col("doc_id").cast("long"))
    many = rows.join(hot, node)
    few = rows.join(hot.select(node), node, "left_anti").join(cold.hint("shuffle_hash"), node, "left")
    held = F.col(n).isNotNull() & F.col(text).isNotNull()
    stayed = held & F.col(stays).isNotNull() & F.col(f"{stays}.id").eqNullSafe(F.col(id_))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    # equal rows of the text that stays are one; those of the others are gone
    def once(df: DataFrame) -> DataFrame:
        return df.where(stayed).dropDuplicates([node]).select(*cols)

    return few.where(~held).select(*cols).unionByName(once(few)).unionByName(once(many))


def brute_force(rows: list[tuple], perms: int = PERMS, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> dict[int, int]:
    """Position of each row to the smallest position of its group, by comparing all signatures; for tests."""
    m = signature_matrix(pa.array([t for _, t in rows], pa.string()), perms, shingle)
    has = (m != 0xFFFFFFFF).any(axis=1)
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if has[i] and has[j] and (m[i] == m[j]).mean() >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(rows))}


def recall_at(similarity: float, perms: int = PERMS, rows: int = ROWS) -> float:
    """Chance that a pair of this Jaccard similarity shares a band."""
    return 1 - math.pow(1 - similarity**rows, perms // rows)
