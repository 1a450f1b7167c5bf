"""Toxic spans: a linear-chain conditional random field over words, and what it says of documents.

Labels are of documents, so those of tokens are made from them.  A word or a beginning of words counts as
offending if it stands in many different contexts (pairs of neighbours) in toxic documents
and hardly any in clean ones; contexts, not documents, because copies of one toxic document
repeat all its harmless words too, and only the first of near copies is used.  How strongly it does so is its
level, kept in a lexicon; the levels of a token's word and of its beginnings are the field's features.

A token's label never comes from what its features come from: the labelled documents are dealt into two halves, each with a
lexicon of its own; a token of a toxic document is labelled toxic by the top level in the lexicon of its own half, and
its features are looked up in the other half's.  So the field learns how far evidence found elsewhere is to be
trusted, for a word, for a beginning of words and beside a neighbour that is toxic.  It is fitted to every token of
these documents, by gradient ascent on the log-likelihood.  The threshold is where F1 of the documents is best, each scored by the other
half's lexicon (the highest such score of equals).

Applied, the lexicon is that of both halves together.  A document's score is the sum of the forward-backward marginals of all its
tokens, the expected number of toxic words, less what as many words without any evidence have (each a fixed, tiny marginal, which
would otherwise add up to a verdict on any text that is long enough); words whose marginal is at least one half (`SPAN`) are its offending offsets.

The fit uses at most `max_docs` labelled documents of each class, the ones with the smallest
hash of doc_id (of these, doc_id and the text's md5 where it repeats); everything else covers every word of every document.

Defined results: a null or empty text scores 0; without a toxic and a clean labelled document in both halves
nothing is toxic; labels with nulls are left out; conflicting or repeated labels of one
doc_id count as toxic if any is; repeated documents score alike; very long texts are read whole, one at a time; an empty table
gives no rows; extra columns are carried along.  doc_id must be a number or a text of one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import Words, char_offsets, mix, slices, words
from ._util import own
from .minhash_dedup import signature_matrix

MAX_DOCS = 4000
PREFIXES = (4, 5, 6, 7)
LEVELS = 4  # of evidence for a word or prefix
SPAN = 0.5
_KINDS = 1 + len(PREFIXES)


# --- features ---------------------------------------------------------------------------


def _key(w: Words, kind: int) -> np.ndarray:
    """Hash of each word (kind 0), or of its first bytes; a shorter word has no such prefix (0)."""
    if not kind:
        return w.hash
    p = PREFIXES[kind - 1]
    long = w.end - w.start > p
    k = np.zeros(len(long), np.uint64)
    k[long] = mix(w.hash_of(w.start[long], w.start[long] + p) + np.uint64(kind))
    return k


def _level(k: np.ndarray, known: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The lexicon's level of each key, 0 if it has none."""
    out = np.zeros(len(k), np.int8)
    if len(known):
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        hit = known[at] == k
        out[hit] = level[at[hit]]
    return out


def _levels(w: Words, lexicon: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of levels for each kind."""
    return np.stack([_level(_key(w, kind), *lexicon[kind]) for kind in range(_KINDS)])


def _emissions(levels: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Score of label toxic against clean of each token."""
    e = np.full(levels.shape[1], theta[0])
    for r in range(_KINDS):
        e += theta[1 + r * LEVELS : 1 + (r + 1) * LEVELS][np.clip(levels[r], 1, LEVELS) - 1] * (levels[r] > 0)
    return e


_N = 1 + _KINDS * LEVELS  # emission weights; then come the transitions clean-clean .. toxic-toxic


# --- inference --------------------------------------------------------------------------


def marginals(e: np.ndarray, of: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of documents laid end to end: forward and backward messages (2 x tokens, scaled), transition and token factors.

    The chain is cut into blocks whose 2x2 products are taken side by side, then linked in
    order: the result is that of the plain recursion.  The step into a document's first
    token forgets what was before."""
    n = len(e)
    block = max(16, min(256, int(np.sqrt(n))))
    m = -(-n // block)
    t = np.exp(trans - trans.max()).reshape(2, 2)

    def laid(x: np.ndarray, fill: float) -> np.ndarray:
        y = np.full(m * block, float(fill))
        y[:n] = x
        return np.ascontiguousarray(y.reshape(m, block).T)

    top = np.maximum(e, 0)
    psi = np.stack([np.exp(-top), np.exp(e - top)])
    p0, p1 = laid(psi[0], 1), laid(psi[1], 1)
    first = np.zeros(n, bool)
    first[of[:-1][np.diff(of) > 0]] = True
    first = laid(first, True) > 0  # what fills the last block tells nothing of the last document either
    a00, a01, a10, a11 = (np.where(first, 1.0, x) * p for x, p in ((t[0, 0], p0), (t[0, 1], p1), (t[1, 0], p0), (t[1, 1], p1)))
    m00, m01, m10, m11 = np.ones(m), np.zeros(m), np.zeros(m), np.ones(m)
    for j in range(block):
        m00, m01 = m00 * a00[j] + m01 * a10[j], m00 * a01[j] + m01 * a11[j]
        m10, m11 = m10 * a00[j] + m11 * a10[j], m10 * a01[j] + m11 * a11[j]
        if j % 8 == 7:
            s = m00 + m01 + m10 + m11
            m00, m01, m10, m11 = m00 / s, m01 / s, m10 / s, m11 / s
    prod = list(zip(m00.tolist(), m01.tolist(), m10.tolist(), m11.tolist()))
    fore, back = [], []
    x, y = 0.5, 0.5
    for q in prod:
        fore.append((x, y))
        x, y = x * q[0] + y * q[2], x * q[1] + y * q[3]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for q in reversed(prod):
        back.append((x, y))
        x, y = q[0] * x + q[1] * y, q[2] * x + q[3] * y
        x, y = x / (x + y), y / (x + y)
    alpha, beta = np.empty((2, block, m)), np.empty((2, block, m))
    x, y = np.array(fore).T
    for j in range(block):
        x, y = x * a00[j] + y * a10[j], x * a01[j] + y * a11[j]
        s = x + y
        x, y = x / s, y / s
        alpha[0, j], alpha[1, j] = x, y
    x, y = np.array(back[::-1]).T
    for j in range(block - 1, -1, -1):
        beta[0, j], beta[1, j] = x, y
        x, y = a00[j] * x + a01[j] * y, a10[j] * x + a11[j] * y
        s = x + y
        x, y = x / s, y / s
    flat = lambda z: z.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    return flat(alpha), flat(beta), t, psi


def posterior(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    g = alpha * beta
    return g[1] / (g[0] + g[1])


def document_scores(p: np.ndarray, of: np.ndarray, base: float) -> np.ndarray:
    """Sum of each document's marginals, less `base` for each of its tokens."""
    total = np.concatenate([[0.0], np.cumsum(p - base)])
    return total[of[1:]] - total[of[:-1]]


def base_rate(theta: np.ndarray, trans: np.ndarray) -> float:
    """The marginal of a token that has no evidence, far from any that has."""
    return float(_marginal(np.zeros((_KINDS, 401), np.int8), np.array([0, 401]), theta, trans)[200])


# --- fitting ----------------------------------------------------------------------------


def _context_of(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash of each word's two neighbours in its document."""
    before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    same = doc[1:] == doc[:-1]
    before[1:] = np.where(same, h[:-1], 0)
    after[:-1] = np.where(same, h[1:], 0)
    return mix(before * np.uint64(3) + after)


def _contexts(k: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, and how many different contexts each has."""
    _, at = np.unique(mix(k * np.uint64(3) + ctx), return_index=True)
    return np.unique(k[at], return_counts=True)


def _without_copies(texts: list[str], toxic: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The first of each group of near copies: what only one text and its copies say is no evidence."""
    arr = pa.array(texts, pa.string())
    m = np.concatenate([signature_matrix(arr[i:j], 64, 3) for i, j in slices(arr)]).view(np.uint64)
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, row in enumerate(mix(m[:, ::2] * np.uint64(3) + m[:, 1::2]).tolist()):
        bands = set(enumerate(row))
        if seen.isdisjoint(bands):
            keep.append(i)
        seen |= bands
    return [texts[i] for i in keep], toxic[keep]


def _lexicon(arr: pa.Array, toxic: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys with a level over 1 of each kind, and their levels."""
    tokens = {True: 0, False: 0}
    lexicon = []
    for kind in range(_KINDS):  # one kind at a time: only its keys are in memory
        seen: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        for i, j in slices(arr):
            w = words(arr[i:j])
            k, inside = _key(w, kind), w.doc_of()
            bad = toxic[i:j][inside]
            if not kind:
                tokens[True] += int(bad.sum())
                tokens[False] += int((~bad).sum())
            ctx = _context_of(w.hash, inside)
            for c in (True, False):
                ok = (bad == c) & (k != 0)
                seen[c].append((k[ok], ctx[ok]))
        (kt, xt), (kc, xc) = (tuple(np.concatenate(x) for x in zip(*seen.pop(c))) for c in (True, False))
        u, a = _contexts(kt, xt)
        u, a = u[a >= least], a[a >= least]
        b = np.zeros(len(u))
        if len(u):
            hit = u[np.minimum(np.searchsorted(u, kc), len(u) - 1)] == kc
            if hit.any():
                v, nb = _contexts(kc[hit], xc[hit])
                b[np.searchsorted(u, v)] = nb
        # log of the ratio of rates, with the clean rate never under half a context
        ratio = np.log((a + 0.5) / max(tokens[True], 1)) - np.log((b + 0.5) / max(tokens[False], 1))
        # how far the toxic share is from the tokens' share, in standard deviations of chance
        share = min(max(tokens[True] / max(1, tokens[True] + tokens[False]), 1e-9), 1 - 1e-9)
        sure = (a - share * (a + b)) / np.sqrt(share * (1 - share) * (a + b))
        level = np.where((ratio >= np.log(20)) & (sure >= (8 if kind else 6)), 4, np.where((ratio >= np.log(20)) & (sure >= 4), 3, np.where((ratio >= np.log(5)) & (sure >= 3), 2, 1)))
        good = level > 1
        lexicon.append((u[good], level[good].astype(np.int8)))
    return lexicon


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 60, least: int = 3) -> dict:
    """The model as plain lists: lexicon, weights, transitions and the document threshold."""
    empty = {"lexicon": [[[], []]] * _KINDS, "theta": [-10.0] + [0.0] * (_N - 1), "trans": [0.0] * 4, "threshold": 1e9}
    if not toxic.any() or toxic.all():
        return empty
    texts, toxic = _without_copies(texts, toxic)
    # alternate documents of each class
    half = np.zeros(len(texts), int)
    for c in (True, False):
        half[toxic == c] = np.arange((toxic == c).sum()) % 2
    parts = [(pa.array([x for x, g in zip(texts, half) if g == h], pa.string()), toxic[half == h]) for h in (0, 1)]
    if any(not t.any() or t.all() for _, t in parts):
        return empty
    lexicons = [_lexicon(a, t, least) for a, t in parts]
    data, slice_of = [], []
    for h, (arr, bad) in enumerate(parts):
        for i, j in slices(arr):
            w = words(arr[i:j])
            y = (_levels(w, lexicons[h]) == 4).any(axis=0) & np.repeat(bad[i:j], w.lengths())
            if len(y):
                data.append((_levels(w, lexicons[1 - h]), y, w.of))
                slice_of.append(bad[i:j])
    if not any(y.any() for _, y, _ in data):
        return empty
    theta, trans = _train(data, rounds)
    base = base_rate(theta, trans)
    score = np.concatenate([document_scores(_marginal(x, o, theta, trans), o, base) for x, _, o in data])
    return {
        "lexicon": [[[int(x) for x in a], [int(x) for x in b]] for a, b in _lexicon(pa.array(texts, pa.string()), toxic, least)],
        "theta": theta.tolist(),
        "trans": trans.tolist(),
        "threshold": _threshold(score, np.concatenate(slice_of)),
    }


def _marginal(lv: np.ndarray, of: np.ndarray, theta: np.ndarray, trans: np.ndarray) -> np.ndarray:
    if not lv.shape[1]:
        return np.zeros(0)
    alpha, beta, _, _ = marginals(_emissions(lv, theta), of, trans)
    return posterior(alpha, beta)


def _gradient(lv: np.ndarray, y: np.ndarray, of: np.ndarray, theta: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of labels y, by weight: what is there less what is expected."""
    alpha, beta, t, psi = marginals(_emissions(lv, theta), of, trans)
    off = y - posterior(alpha, beta)
    g = np.zeros(_N + 4)
    g[0] = off.sum()
    for r in range(_KINDS):
        g[1 + r * LEVELS : 1 + (r + 1) * LEVELS] = np.bincount(lv[r], off, LEVELS + 1)[1:]
    inside = np.ones(len(y), bool)
    inside[of[:-1][np.diff(of) > 0]] = False
    j = np.flatnonzero(inside)
    if len(j):
        yi = y.astype(np.int64)
        right = psi[:, j] * beta[:, j]
        pair = [alpha[a, j - 1] * t[a, b] * right[b] for a in (0, 1) for b in (0, 1)]
        whole = pair[0] + pair[1] + pair[2] + pair[3]
        g[_N:] = np.bincount(yi[j - 1] * 2 + yi[j], minlength=4) - [(p / whole).sum() for p in pair]
    return g


def _train(data: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the penalised log-likelihood of every token, slice by slice."""
    n = sum(len(y) for _, y, _ in data)
    w = np.zeros(_N + 4)
    w[0] = -3
    mom, var = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        g = sum(_gradient(lv, y.astype(float), of, w[:_N], w[_N:]) for lv, y, of in data) / n - 1e-5 * w
        mom = 0.9 * mom + 0.1 * g
        var = 0.99 * var + 0.01 * g * g
        w = w + 0.3 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return w[:_N], w[_N:]


def _threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """Between two neighbouring scores, where F1 on the labelled documents is best."""
    order = np.argsort(-score, kind="stable")
    s, t = score[order], toxic[order]
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + t.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float(max(1e-6, (s[k] + below) / 2))


def model(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> dict:
    lab = own(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    h = F.xxhash64("doc_id")
    picked = lab.where("toxic = 1").orderBy(h, "doc_id").limit(max_docs).union(lab.where("toxic = 0").orderBy(h, "doc_id").limit(max_docs))
    # at most 2 * max_docs rows: what is sent to every executor doesn't grow with the data
    known = own(docs, "doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    # nor does what one task fits, however often a doc_id repeats
    first = [h, "doc_id", F.md5("text")]
    rows = known.where("toxic = 1").orderBy(*first).limit(max_docs).union(known.where("toxic = 0").orderBy(*first).limit(max_docs)).select("text", "toxic")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [p for p in parts if len(p)]
        if got:
            all_ = pd.concat(got).sort_values(["text", "toxic"], kind="stable")
            yield pd.DataFrame({"model": [json.dumps(fit(all_["text"].tolist(), all_["toxic"].to_numpy() == 1))]})

    found = rows.repartition(1).mapInPandas(run, "model string").first()
    return json.loads(found.model) if found else fit([], np.zeros(0, bool))


# --- application ------------------------------------------------------------------------


class Scorer:
    def __init__(self, m: dict):
        self.lexicon = [(np.array(a, np.uint64), np.array(b, np.int8)) for a, b in m["lexicon"]]
        self.theta, self.trans, self.threshold = np.array(m["theta"]), np.array(m["trans"]), m["threshold"]
        self.base = base_rate(self.theta, self.trans)

    def __call__(self, arr: pa.Array, located: bool = True) -> tuple[np.ndarray, list]:
        """Scores, and (if located) of each document over the threshold [(start, end, probability)] in characters."""
        w = words(arr)
        n = len(arr)
        if not len(w.start):
            return np.zeros(n), [None] * n
        p = _marginal(_levels(w, self.lexicon), w.of, self.theta, self.trans)
        score = document_scores(p, w.of, self.base)
        spans: list = [None] * n
        for d in np.flatnonzero(score >= self.threshold) if located else ():
            lo, hi = w.of[d], w.of[d + 1]
            hit = lo + np.flatnonzero(p[lo:hi] >= SPAN)
            a, b = (char_offsets(w.data, w.at[d], x[hit]) for x in (w.start, w.end))
            spans[d] = [{"start": int(x), "end": int(y), "p": round(float(q), 4)} for x, y, q in zip(a, b, p[hit])]
        return score, spans


def score(docs: DataFrame, m: dict) -> DataFrame:
    """doc_id, score, toxic, spans of every document."""
    schema = "doc_id long, score double, toxic boolean, spans array<struct<start:int,end:int,p:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m)
        for batch in batches:
            for i, j in slices(batch.column("text")):
                s, spans = scorer(batch.column("text")[i:j])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(s), pa.array(s >= scorer.threshold), pa.array(spans, kind)], names=["doc_id", "score", "toxic", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, m: dict) -> DataFrame:
    """docs without the toxic ones, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m)
        for batch in batches:
            text = batch.column(at)
            for i, j in slices(text):
                s, _ = scorer(text[i:j], located=False)
                yield batch[i:j].filter(pa.array(s < scorer.threshold))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
