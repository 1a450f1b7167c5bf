"""Repeated runs of lines: a suffix array over line ids by distributed prefix doubling.

A document is the sequence of its lines that aren't blank.  A line that occurs once can't
belong to a repeat and ends a run.  The others' suffixes are ranked by their first 1, 2, 4, ...
lines: a round joins the rank of each position with that of the position as many lines further
on and ranks the distinct pairs by range partitions, whose ranks need no counting across partitions
(partition number, then place within it); a line or a pair that very many places have is one row there.  It ends when all suffixes that have so many
lines differ.  Ranks in order are the suffix array; suffixes that agree in
`least` lines are its intervals of common prefixes of that length, and the common prefix of neighbours within an
interval, found by descending the rounds, is the length of the maximal repeated run there.

Of each interval the run with the smallest (doc_id, position) stays; the lines of later copies are deleted,
but not of a copy that overlaps the one that stays.

Defined results: null texts stay null; blank lines are kept and never compared; lines are compared as they are, without
white space at the ends, and one line is a run like any other: of a line that repeats anywhere one
copy stays, however short it is (a larger `least` spares runs of fewer lines); equal rows (doc_id and text) are one document and get the same edit; a null
doc_id comes last; an empty table gives no rows; very long texts are split and put together once; extra columns are carried along by drop_lines().
doc_id must be a number or a text of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import discard, fresh, materialize, spread_join

LEAST = 1
_LAST = (1 << 63) - 1


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, node, pos (among lines that aren't blank), line (among all), h."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("node"), F.split("text", "\n").alias("l"))
    numbered = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("line"), F.trim(x, F.lit(" \t\r")).alias("t"))), lambda s: s["t"] != "")
    return base.select("doc", "node", F.posexplode(numbered).alias("pos", "s")).select("doc", "node", "pos", F.col("s.line").alias("line"), F.xxhash64("s.t").alias("h"))


def ranked(pairs: DataFrame) -> DataFrame:
    """pairs (doc, node, pos, r1, r2, whole) with rank in place of r1 and r2: equal for equal pairs, and ordered like them.

    The distinct pairs are ranged and numbered, so a pair that very many positions have is one row there; the numbers go back by spread_join."""
    pairs = materialize(pairs)
    key = F.xxhash64("r1", "r2")
    each = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n"))
    placed = each.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for b in batches:
            rank = (b.column("part").to_numpy(zero_copy_only=False).astype(np.int64) << 40) + place + np.arange(len(b))
            place += len(b)
            yield pa.RecordBatch.from_arrays([b.column("r1"), b.column("r2"), b.column("n"), pa.array(rank)], names=["k1", "k2", "n", "rank"])

    ranks = materialize(placed.mapInArrow(run, "k1 long, k2 long, n long, rank long").withColumn("key", F.xxhash64("k1", "k2")))
    # two pairs of one hash are told apart after the join
    out = spread_join(pairs.withColumn("key", key), ranks, "key", pairs.count()).where("r1 = k1 and r2 = k2").select("doc", "node", "pos", "rank", "whole")
    done = materialize(out)
    discard(pairs, ranks)
    return done


def suffix_ranks(first: DataFrame) -> list[DataFrame]:
    """first (doc, node, pos, h) as its rounds: of round k each suffix's rank by 2 ** k lines; whole tells that it has so many."""
    rounds = [ranked(first.select("doc", "node", "pos", F.col("h").alias("r1"), F.lit(0).cast("long").alias("r2"), F.lit(True).alias("whole")))]
    while not rounds[-1].where("whole").groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        k = len(rounds) - 1
        a, b = rounds[-1], rounds[-1].select("doc", "node", (F.col("pos") - (1 << k)).alias("pos"), F.col("rank").alias("r2"), F.col("whole").alias("w2"))
        pairs = a.join(b, ["doc", "node", "pos"], "left").select("doc", "node", "pos", F.col("rank").alias("r1"), F.coalesce("r2", F.lit(-1)).alias("r2"), (F.col("whole") & F.coalesce("w2", F.lit(False))).alias("whole"))
        rounds.append(ranked(pairs))
    return rounds


def _at(rounds: list[DataFrame], k: int, rows: DataFrame, doc: str, node: str, pos: str, name: str) -> DataFrame:
    """rows with round k's rank of (doc, node, pos), null where that has no 2 ** k lines."""
    r = rounds[k].where("whole").select(F.col("doc").alias(doc), F.col("node").alias(node), F.col("pos").alias("__p"), F.col("rank").alias(name))
    return rows.join(r, (rows[doc] == r[doc]) & (rows[node] == r[node]) & (F.expr(pos) == r["__p"]), "left").drop(r[doc], r[node], r["__p"])


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc, node, line of each line in a later copy of `least` lines, and run: the longest common prefix found there."""
    every = lines_of(docs)
    count = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    lines = materialize(every.join(count, "h", "left_semi").dropDuplicates(["doc", "node", "pos"]))
    rounds = suffix_ranks(lines)
    # the rank by exactly `least` lines: two overlapping powers of two
    k = least.bit_length() - 1
    if len(rounds) <= k:
        return lines.where("false").select("doc", "node", "line", F.lit(0).alias("run"))
    head = rounds[k].where("whole").select("doc", "node", "pos", F.col("rank").alias("c1"))
    tail = rounds[k].where("whole").select("doc", "node", (F.col("pos") - (least - (1 << k))).alias("pos"), F.col("rank").alias("c2"))
    order = rounds[-1].select("doc", "node", "pos", "rank")
    runs = head.join(tail, ["doc", "node", "pos"]).join(order, ["doc", "node", "pos"])
    runs = materialize(runs.withColumn("key", F.xxhash64("c1", "c2")))
    # of each class the first copy, by an aggregate: a line that a third of all places have isn't sorted in one task
    class_ = materialize(runs.groupBy("key").agg(F.min(F.struct("doc", "node", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    ordered = spread_join(runs, class_, "key", runs.count()).select("doc", "node", "pos", "key", "rank", "first")
    place = ["rank", "doc", "node", "pos"]
    # the suffix array, in ranges; the neighbour before a range's first suffix is the last of the range before
    sa = materialize(ordered.repartitionByRange(*place).withColumn("part", F.spark_partition_id()))
    last = sa.groupBy("part").agg(F.max(F.struct(*place, "key")).alias("last"))
    edge = last.select("part", F.lag("last").over(W.orderBy("part")).alias("edge"))  # one row a range
    w = W.partitionBy("part").orderBy(*place)
    beside = sa.withColumn("b", F.lag(F.struct(*place, "key")).over(w)).join(F.broadcast(edge), "part").withColumn("b", F.coalesce("b", "edge"))
    before = F.when(F.col("b.key") == F.col("key"), F.col("b"))
    runs_ = beside.withColumn("before", before)
    own = (F.col("doc") == F.col("first.doc")) & (F.col("node") == F.col("first.node"))
    runs_ = runs_.withColumn("copy", ~own | (F.col("pos") >= F.col("first.pos") + least))
    found = materialize(runs_.select("doc", "node", "pos", "copy", F.col("before.doc").alias("bdoc"), F.col("before.node").alias("bnode"), F.col("before.pos").alias("bpos")))
    discard(runs, class_, sa)
    runs = found
    lcp = runs.withColumn("run", F.lit(0))
    for j in range(len(rounds) - 1, -1, -1):
        lcp = _at(rounds, j, lcp, "doc", "node", "pos + run", "x")
        lcp = _at(rounds, j, lcp, "bdoc", "bnode", "bpos + run", "y")
        lcp = lcp.withColumn("run", F.when(F.col("x") == F.col("y"), F.col("run") + (1 << j)).otherwise(F.col("run"))).drop("x", "y")
    out = materialize(lcp.select("doc", "node", "pos", "copy", "run"))
    discard(runs, *rounds)
    marks = out.where("copy").select("doc", "node", F.explode(F.sequence("pos", F.col("pos") + (least - 1))).alias("pos"), "run")
    cut = marks.groupBy("doc", "node", "pos").agg(F.max("run").alias("run")).join(lines, ["doc", "node", "pos"]).select("doc", "node", "line", "run")
    done = materialize(cut)
    discard(lines, out)
    return done


def drop_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the lines of later copies deleted from text."""
    return _edited(docs, least)[0].select(*[F.col(f"`{c}`") for c in docs.columns])


def _edited(docs: DataFrame, least: int) -> tuple[DataFrame, str, str]:
    """docs with text edited, and two more columns: the numbers of the deleted lines, and the longest run."""
    node, cut, run = fresh(docs, "node", "cut", "run")
    marks = repeats(docs, least).groupBy("node").agg(F.collect_set("line").alias(cut), F.max("run").alias(run)).withColumnRenamed("node", node)
    joined = docs.withColumn(node, F.xxhash64("doc_id", "text")).join(marks.hint("shuffle_hash"), node, "left")
    # a generator of one row, so the text is split once and not for each line that stays
    lines, here = fresh(joined, "lines", "here")
    split = joined.withColumn(here, F.array(F.when(F.col(cut).isNotNull(), F.split("text", "\n")))).withColumn(lines, F.explode_outer(here))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return split.withColumn("text", text), cut, run


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text without later copies, lines_deleted and longest_run of every document."""
    out, cut, run = _edited(docs.select("doc_id", "text"), least)
    return out.select("doc_id", "text", F.coalesce(F.size(cut), F.lit(0)).alias("lines_deleted"), F.coalesce(F.col(run), F.lit(0)).alias("longest_run"))


def brute_force(rows: list[tuple], least: int = LEAST) -> list[str]:
    """The edited texts, by a dictionary of all runs; for tests."""
    key = lambda r: (r[0] is None, r[0] or 0)
    seqs = {r: [(i, x.strip(" \t\r")) for i, x in enumerate(r[1].split("\n")) if x.strip(" \t\r")] for r in rows if r[1] is not None}
    at: dict[tuple, list] = {}
    for r in sorted(seqs, key=key):
        for p in range(len(seqs[r]) - least + 1):
            at.setdefault(tuple(x for _, x in seqs[r][p : p + least]), []).append((r, p))
    dead: dict[tuple, set] = {}
    for occ in at.values():
        for r, p in occ[1:]:
            if r != occ[0][0] or p >= occ[0][1] + least:
                dead.setdefault(r, set()).update(i for i, _ in seqs[r][p : p + least])
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dead.get((d, t), ())) for d, t in rows]
