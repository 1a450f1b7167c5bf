"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated from the votes.

Each rule says good (1), bad (-1) or nothing (0) of a text.  With the true quality unseen,
expectation-maximisation estimates how often each rule that votes is right about good and about bad texts (rules
independent given the quality, an abstention no evidence) and how many are good; the posterior
probability of good replaces the filter that all rules must pass.  The votes of all
documents enter, as the counts of the patterns of votes; there are at most
3 ** 12 of them, however many documents.

Defined results: a null, empty or wordless text has posterior 0; equal texts get equal
posteriors, and one of exactly `keep` stays; very long texts are read whole; an empty table gives an empty result; extra columns are carried along
by keep_good().  doc_id must be a number or a text of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import bytes_of, grams, mix, slices, words
from ._util import fresh, materialize

KEEP = 0.5
RULES = ("length", "capitals", "symbols", "word_size", "stutter", "variety", "cells", "shouting", "sentences", "loops", "odd_runs", "odd_words")
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*@^~=+<>{}[]|\\/_"]] = True


def votes(arr: pa.Array) -> np.ndarray:
    """A row of votes for each text; all -1 for texts without words."""
    filled = pc.fill_null(arr, "")
    w = words(filled)
    n = np.diff(w.of).astype(float)
    safe = np.maximum(n, 1)
    raw, at = bytes_of(filled)

    def share(mask: np.ndarray, total: np.ndarray | float = 1.0) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[at[1:]] - c[at[:-1]]) / np.maximum(total, 1)

    def per_doc(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return c[of[1:]] - c[of[:-1]]

    letters = share(_LETTER[raw])
    after = np.append(raw[1:], 0)
    h = w.hash
    doc = w.doc_of()
    twin = np.zeros(len(h), bool)
    if len(h) > 1:
        twin[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])

    def kinds(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        salt = mix(d.astype(np.uint64))
        return np.bincount(d[np.unique(x ^ salt, return_index=True)[1]], minlength=len(n))

    distinct = kinds(h, doc)
    g, first, gof = grams(h, w.of, 4)
    gdistinct = kinds(g, doc[first])
    ng = np.diff(gof)
    chars = per_doc((w.end - w.start).astype(float), w.of)
    f = {
        "length": n,
        "capitals": share(_UPPER[raw], letters),
        "symbols": share(_ODD[raw]) / safe,
        "word_size": chars / safe,
        "stutter": per_doc(twin.astype(float), w.of) / safe,
        "variety": distinct / np.sqrt(safe),
        "cells": share((raw == ord("|")).astype(float)) / safe,
        "shouting": share(((raw == ord("!")) & (after == ord("!"))).astype(float)) / safe,
        "sentences": share(np.isin(raw, [ord("."), ord("?"), ord("!")]).astype(float)) / safe,
        "loops": 1 - gdistinct / np.maximum(ng, 1),
        "odd_runs": share((_ODD[raw] & (after == raw)).astype(float)) / safe,
        "odd_words": share((_ODD[raw] & ~_ODD[after]).astype(float)) / safe,
    }
    brief = n < 20
    # each rule: bad if over (or under) one bound, good if within the other, else nothing
    high = lambda x, good, bad: np.where(x > bad, -1, np.where(x <= good, 1, 0))
    out = np.stack(
        [
            np.where(n < 3, -1, np.where(n >= 40, 1, 0)),
            np.where(letters < 20, 0, high(f["capitals"], 0.15, 0.4)),
            high(f["symbols"], 0.02, 0.15),
            np.where(brief, 0, np.where((f["word_size"] > 14) | (f["word_size"] < 2.5), -1, np.where((f["word_size"] > 3) & (f["word_size"] < 10), 1, 0))),
            np.where(brief, 0, high(f["stutter"], 0.02, 0.15)),
            np.where(brief, 0, np.where(f["variety"] < 1.5, -1, np.where(f["variety"] > 3, 1, 0))),
            high(f["cells"], 0.005, 0.15),
            high(f["shouting"], 0.01, 0.15),
            np.where(brief, 0, np.where((f["sentences"] < 0.005) | (f["sentences"] > 0.6), -1, np.where((f["sentences"] > 0.03) & (f["sentences"] < 0.35), 1, 0))),
            np.where(ng < 20, 0, high(f["loops"], 0.1, 0.35)),
            high(f["odd_runs"], 0.01, 0.1),
            high(f["odd_words"], 0.02, 0.2),
        ],
        axis=1,
    ).astype(np.int8)
    out[n == 0] = -1
    return out


def voted(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the text), has_words, votes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                v = votes(b.column("text")[i:j])
                some = (v != -1).any(axis=1) | (np.diff(words(b.column("text")[i:j]).of) > 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("node")[i:j], pa.array(some), pa.array([bytes(x) for x in (v + 1).astype(np.uint8)], pa.binary())], names=["doc_id", "node", "has_words", "votes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("node"), "text").mapInArrow(run, "doc_id long, node long, has_words boolean, votes binary")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of good, and P(vote | quality, not abstaining) as rules x (bad, good) x (-1, 0, 1), from patterns of votes and their counts.

    An abstention is no evidence: its place holds 1 for both.

    Begins with how many rules object (none: 0.88, one: 0.5, two: 0.12, ..), which also says which class is called good."""
    n, r = patterns.shape
    onehot = patterns[:, :, None] == np.array([-1, 0, 1])[None, None, :]
    q = 1 / (1 + np.exp(2.0 * (patterns == -1).sum(axis=1) - 2.0))
    prior, p = 0.5, np.ones((r, 2, 3))
    for _ in range(rounds):
        for c, w in ((1, q * counts), (0, (1 - q) * counts)):
            voted = np.einsum("n,nrv->rv", w, onehot)[:, [0, 2]] + 0.5
            p[:, c, ::2] = voted / voted.sum(axis=1, keepdims=True)
        prior = float(np.clip((q * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        odds = np.log(prior / (1 - prior)) + np.einsum("nrv,rv->n", onehot, np.log(p[:, 1] / p[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return prior, p


def posteriors(docs: DataFrame) -> DataFrame:
    """doc_id, node, posterior, and each rule's vote, of every document."""
    v = materialize(voted(docs))
    rows = v.where("has_words").groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** rules
    if rows:
        rows.sort(key=lambda x: bytes(x.votes))
        prior, p = estimate(np.array([[int(c) - 1 for c in bytes(x.votes)] for x in rows]), np.array([x.n for x in rows], float))
    else:
        prior, p = 0.5, np.full((len(RULES), 2, 3), 1 / 3)
    codes = [F.conv(F.hex(F.substring("votes", i + 1, 1)), 16, 10).cast("int") for i in range(len(RULES))]
    out = v.select("doc_id", "node", "has_words", *[c.alias(f"c{i}") for i, c in enumerate(codes)])
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for i in range(len(RULES)):
        ratio = [float(x) for x in np.log(p[i, 1] / p[i, 0])]
        odds = odds + F.when(F.col(f"c{i}") == 0, ratio[0]).when(F.col(f"c{i}") == 1, ratio[1]).otherwise(ratio[2])
    post = F.when(F.col("has_words"), 1 / (1 + F.exp(-odds))).otherwise(0.0)
    return out.select("doc_id", "node", F.round(post, 9).alias("posterior"), *[(F.col(f"c{i}") - 1).alias(f"vote_{r}") for i, r in enumerate(RULES)])


def keep_good(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """docs whose posterior is at least keep, with all their columns."""
    (node,) = fresh(docs, "node")
    good = posteriors(docs).where(F.col("posterior") >= keep).select(F.col("node").alias(node)).distinct()
    return docs.withColumn(node, F.xxhash64("text")).join(good.hint("shuffle_hash"), node, "left_semi").drop(node)
