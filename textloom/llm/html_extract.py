"""Main content of web pages by wrapper induction.

Pages of one host are parsed to trees and aligned with one of them, its reference, by simple
tree matching: the largest mapping that keeps tags, parents and the order of siblings.  A text's
slot is the place of the reference's text that it maps to; what maps to nothing, as in a longer
list, shares a slot with what has the same tags from the root on.

One wrapper is induced for a host, from counts over all of its distinct pages:

* a text that stands in its slot on all but `varies` of the host's pages is constant;
* a host may have several templates: a page's frequent texts are ordered by the number of pages they are on
  (falling; then by slot and hash), as texts that stand together are on as many; two that follow each other in that
  order on all but `varies` of the pages that the first is on are bound.  A page's template is named by
  its first bound text, and what is on all but `varies` of the pages of that template is constant on them.

Constant text is template, all else is content: a text that merely repeats, as an author's name
does, is in a varying slot.  A page of which that would leave nothing outside of nav, header, footer and aside is
a near copy of others rather than an instance of their template: of it only what is constant on the host is
template or, if that leaves nothing either, what is in those four tags.  A text is frequent if it is on at least `rare` of the host's distinct pages
and on `LEAST` of them; as a page has so many texts, that bounds the wrapper, however large the host.

Nothing is grouped by host: counts are combined before they are shuffled, and pages meet the
wrapper of their host by a broadcast if all wrappers together are within `limit` bytes, else in
salted parts of a host, sorted so that the wrapper comes first and the pages stream by.

Defined results: a null or empty html gives an empty content; a null or odd url belongs to host '';
equal pages of a host count once and get the same result, so do their repeats; of a host with one distinct page
nothing is known to be constant, and its text outside of nav, header, footer and aside is the content; on a host
with two, what both have in the same slot is constant; the reference is the page with the smallest hash among those of
median size (sizes in steps of a fifth); markup that isn't closed is closed where HTML does; any
depth of nesting and number of siblings is aligned as it is (siblings take time, not memory, in
the product of the kinds that differ); an empty table gives no rows; extra columns are ignored.
page_id must be a number or a text of one.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import discard, materialize, own

VARIES, RARE, LEAST = 0.1, 0.001, 3
LIMIT = 32 << 20  # bytes of wrappers that may be broadcast
LARGE = 500_000  # at most so many hosts are told to be large

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
    "thead": frozenset(["tr", "td", "th", "tbody"]), "tbody": frozenset(["tr", "td", "th", "thead"]), "body": frozenset(["head"]),
}
_P_ENDERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = frozenset("ul ol dl table html body div article section nav td th".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup u var #text".split())
_ASIDE = frozenset("nav header footer aside".split())
_SPACE = re.compile(r"\s+")


# --- trees --------------------------------------------------------------------------------


class Tree:
    """tag, text and children of the nodes in document order; node 0 is the root."""

    __slots__ = ("tag", "text", "kids")

    def __init__(self):
        self.tag, self.text, self.kids = ["#root"], [""], [[]]

    def add(self, parent: int, tag: str, text: str = "") -> int:
        self.tag.append(tag)
        self.text.append(text)
        self.kids.append([])
        self.kids[parent].append(len(self.tag) - 1)
        return len(self.tag) - 1


def parse(page: str | None) -> Tree:
    t, page, at = Tree(), page or "", 0
    tags, stack, open_ = t.tag, [0], Counter()

    def words(s: str) -> None:
        s = _SPACE.sub(" ", _html.unescape(s) if "&" in s else s).strip()
        if s:
            t.add(stack[-1], "#text", s)

    def shut(k: int) -> None:
        for n in stack[k:]:
            open_[tags[n]] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(2):
            if open_[tag] > 0:
                k = len(stack) - 1
                while tags[stack[k]] != tag:
                    k -= 1
                shut(k)
            continue
        if tag in _P_ENDERS and open_["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == "p":
                    shut(k)
                    break
                if tags[stack[k]] in _SCOPE:
                    break
        ends = _CLOSES.get(tag)
        if ends:
            while len(stack) > 1 and tags[stack[-1]] in ends:
                shut(len(stack) - 1)
        node = t.add(stack[-1], tag)
        if tag not in _VOID and not m.group(4).endswith("/"):
            stack.append(node)
            open_[tag] += 1
    if at < len(page):
        words(page[at:])
    return t


class Aligner:
    """Matches trees with a reference.  Subtrees of one shape (tags alone) are one class, and the work for two classes is done once."""

    def __init__(self, ref: Tree):
        self.ref, self.ids, self.shape, self.memo = ref, {}, [], {}
        self.cls = self.classes(ref)
        self.nth = {n: i for i, n in enumerate(n for n, tag in enumerate(ref.tag) if tag == "#text")}

    def classes(self, t: Tree) -> list[int]:
        out = [0] * len(t.tag)
        for n in range(len(t.tag) - 1, -1, -1):  # children come after their parent
            key = (t.tag[n], tuple([out[k] for k in t.kids[n]]))
            c = self.ids.get(key)
            if c is None:
                c = self.ids[key] = len(self.shape)
                self.shape.append((*key, 1 + sum(self.shape[k][2] for k in key[1])))
            out[n] = c
        return out

    def _quick(self, a: int, b: int) -> int | None:
        x, y = self.shape[a], self.shape[b]
        if x[0] != y[0]:
            return 0
        if a == b:
            return x[2]
        return self.memo.get((a, b)) if x[1] and y[1] else 1

    def match(self, a: int, b: int) -> int:
        """Size of the largest top-down mapping between trees of two classes; 0 if the roots differ."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._quick(x, y) is None:
                i, j, k = _middle(self.shape[x][1], self.shape[y][1])
                p, q = self.shape[x][1], self.shape[y][1]
                one, two = p[i : len(p) - k], q[j : len(q) - k]
                need = [(u, v) for u in set(one) for v in set(two) if self._quick(u, v) is None]
                if need:
                    todo += need
                    continue
                same = sum(self.shape[c][2] for c in (*p[:i], *p[len(p) - k :]))
                self.memo[x, y] = 1 + same + int(_row(*self._weights(one, two))[-1])
            todo.pop()
        return self._quick(a, b)

    def _weights(self, one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of the distinct classes of both, and where each child's is."""
        u, v = sorted(set(one)), sorted(set(two))
        at, of = {c: i for i, c in enumerate(u)}, {c: i for i, c in enumerate(v)}
        w = np.array([[self.match(x, y) for y in v] for x in u], np.int64).reshape(len(u), len(v))
        return w, np.array([at[c] for c in one], np.int64), np.array([of[c] for c in two], np.int64)

    def align(self, page: Tree) -> dict[int, int]:
        """Text node of page to the number of the reference's text that it maps to."""
        cls, out = self.classes(page), {}
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if self.ref.tag[a] == "#text":
                out[b] = self.nth[a]
                continue
            p, q = self.ref.kids[a], page.kids[b]
            if self.cls[a] == cls[b]:
                todo += zip(p, q)
            elif p and q:
                one, two = [self.cls[k] for k in p], [cls[k] for k in q]
                i, j, k = _middle(one, two)
                todo += zip(p[:i], q[:j])
                todo += zip(p[len(p) - k :], q[len(q) - k :])
                one, two = tuple(one[i : len(one) - k]), tuple(two[j : len(two) - k])
                if one and two:
                    todo += [(p[i + x], q[j + y]) for x, y in _pairs(*self._weights(one, two))]
        return out


def _middle(a, b) -> tuple[int, int, int]:
    """How many children at the start, and at the end, are alike on both sides: these map to each other in a largest mapping."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    k = 0
    while k < n - i and a[len(a) - 1 - k] == b[len(b) - 1 - k]:
        k += 1
    return i, i, k


def _row(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most nodes that all of a and the first j of b map, in order, for each j; linear memory."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        nxt = np.maximum(row[1:], row[:-1] + w[x][b])
        np.maximum.accumulate(nxt, out=row[1:])
    return row


def _pairs(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A largest mapping in order: by halves of a, so memory stays linear, down to small tables."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1 or len(a) * len(b) <= 1 << 16:
        rows = [np.zeros(len(b) + 1, np.int64)]
        for x in a:
            rows.append(np.concatenate([[0], np.maximum.accumulate(np.maximum(rows[-1][1:], rows[-1][:-1] + w[x][b]))]))
        i, j, out = len(a), len(b), []
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]
    half = len(a) // 2
    k = int(np.argmax(_row(w, a[:half], b) + _row(w, a[half:][::-1], b[::-1])[::-1]))
    return _pairs(w, a[:half], b[:k]) + [(half + i, k + j) for i, j in _pairs(w, a[half:], b[k:])]


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_steps: dict[tuple[int, str], int] = {}


def _step(path: int, tag: str) -> int:
    """The path of a child of tag; below 0, so it is no number of a reference's text."""
    if len(_steps) > 200_000:
        _steps.clear()
    at = _steps.get((path, tag))
    if at is None:
        at = _steps[path, tag] = -(_hash(str(path), tag) & (1 << 62) - 1) - 1
    return at


def texts(t: Tree) -> list[tuple[int, int, bool, int]]:
    """Text nodes in order, with the number of the block of text each is in, whether it is in nav and the like, and its path; the head is left out."""
    out: list[tuple[int, int, bool, int]] = []
    block, todo = 0, [(0, False, -1)]
    while todo:
        n, aside, path = todo.pop()
        if n < 0:
            block += 1
            continue
        tag = t.tag[n]
        if tag == "#text":
            out.append((n, block, aside, path))
        elif tag not in ("head", "title"):
            if tag not in _INLINE:
                block += 1
                todo.append((-1, False, 0))
            aside, path = aside or tag in _ASIDE, _step(path, tag)
            todo += [(k, aside, path) for k in reversed(t.kids[n])]
    return out


# --- pages --------------------------------------------------------------------------------


class Reader:
    """Pages as lists of (slot, hash) beside their text, block and aside."""

    def __init__(self, ref: str | None):
        self.tree = parse(ref)
        self.aligner = Aligner(self.tree)

    def __call__(self, page: str | None) -> tuple[list[tuple[int, int]], list[tuple[str, int, bool]]]:
        if len(self.aligner.shape) > 200_000 or len(self.aligner.memo) > 500_000:
            self.aligner = Aligner(self.tree)
        t = parse(page)
        at = self.aligner.align(t)
        listed = texts(t)
        return [(at.get(n, path), _hash(t.text[n])) for n, _, _, path in listed], [(t.text[n], block, aside) for n, block, aside, _ in listed]


def _frequent(places: list[tuple[int, int]], n: dict) -> list[tuple[int, int]]:
    """The frequent texts of a page, the most frequent first."""
    return sorted({p for p in places if p in n}, key=lambda p: (-n[p], p))


def _named(places: list[tuple[int, int]], n: dict, bonds: set) -> tuple[int, int] | None:
    """The text that a page's template is named by, or None."""
    some = _frequent(places, n)
    return next((two[0] for two in zip(some, some[1:]) if two in bonds), None)


def _content(parts: list[tuple[str, int, bool]]) -> str:
    lines: list[list[str]] = []
    last = None
    for text, block, _ in parts:
        if block != last:
            lines.append([])
            last = block
        lines[-1].append(text)
    return "\n".join(" ".join(x) for x in lines)


def _kept(places: list, parts: list[tuple[str, int, bool]], *fixed: set) -> tuple[str, int, int]:
    """content, template_nodes, content_nodes by the first of the sets of fixed texts that leaves any text outside of nav and the like, else by those tags."""
    for some in fixed:
        keep = [x for x, at in zip(parts, places) if at not in some]
        if not all(x[2] for x in keep):
            break
    else:
        keep = [x for x in parts if not x[2]]
    return _content(keep), len(parts) - len(keep), len(keep)


class Wrapper:
    """What a host's pages have in common."""

    def __init__(self, side: str | None):
        s = json.loads(side) if side else {}
        self.pages = s.get("pages", 0)
        self.n = {(a, b): n for a, b, n in _rows(s, "freq")}
        self.constant = {(a, b) for a, b, c in _rows(s, "constant")}
        self.bonds = {((a, b), (c, d)) for a, b, c, d in _rows(s, "bonds")}
        self.templates = defaultdict(set)
        for a, b, c, d in _rows(s, "templates"):
            self.templates[a, b].add((c, d))

    def __call__(self, places: list, parts: list) -> tuple[str, int, int]:
        """content, template_nodes, content_nodes."""
        mine = self.templates.get(_named(places, self.n, self.bonds), set())
        return _kept(places, parts, self.constant | mine, self.constant) if self.pages > 1 else _kept(places, parts)


def _rows(side: dict, name: str) -> Iterator[list[int]]:
    """Rows written as text: JSON's numbers needn't hold 64 bits."""
    for row in (side.get(name) or "").split(";"):
        if row:
            yield [int(x) for x in row.split(",")]


def extract(pages: list[str | None], varies: float = VARIES, rare: float = RARE, least: int = LEAST) -> list[tuple[str, int, int]]:
    """content, template_nodes, content_nodes of each of one host's pages, by plain sets of pages: what contents() is held to."""
    distinct = {hashlib.md5((p or "").encode()).hexdigest(): p or "" for p in pages}
    step = lambda p: int(math.log(len(p) + 1.0) / math.log(2.0) * 4)
    steps = sorted(step(p) for p in distinct.values())
    ref = distinct[min(k for k, p in distinct.items() if step(p) == steps[(len(steps) - 1) // 2])] if distinct else ""
    read = Reader(ref)
    done = {k: read(p) for k, p in distinct.items()}
    on: dict[tuple[int, int], set[str]] = defaultdict(set)
    for k, (places, _) in done.items():
        for p in places:
            on[p].add(k)
    total = len(distinct)
    n = {p: len(s) for p, s in on.items() if len(s) >= max(least, rare * total)}
    follow: dict[tuple, set[str]] = defaultdict(set)
    order = {k: _frequent(places, n) for k, (places, _) in done.items()}
    for k, some in order.items():
        for two in zip(some, some[1:]):
            follow[two].add(k)
    bonds = {(a, b) for (a, b), s in follow.items() if len(s) >= (1 - varies) * max(n[a], n[b])}
    of: dict[tuple, set[str]] = defaultdict(set)
    for k, some in order.items():
        name = _named(some, n, bonds)
        if name:
            of[name].add(k)
    out = {}
    for k, (places, parts) in done.items():
        mine = of.get(_named(order[k], n, bonds), set())
        constant = {p for p in places if len(on[p]) >= (1 - varies) * total}
        template = {p for p in places if p in n and mine and len(on[p] & mine) >= (1 - varies) * len(mine)}
        out[k] = _kept(places, parts, constant | template, constant) if total > 1 else _kept(places, parts)
    return [out[hashlib.md5((p or "").encode()).hexdigest()] for p in pages]


# --- tables -------------------------------------------------------------------------------


def _beside(rows: DataFrame, sides: DataFrame, large: DataFrame, run: Callable, schema: str, limit: int) -> DataFrame:
    """run(host, side, batch) over rows (host, key, ..), each with the side (text) of its host; sides is a written table.

    Within limit bytes the sides are broadcast; else a host's rows are salted, and the side of each part of them is sorted before them."""
    size = sides.agg(F.sum(F.octet_length("host") + F.octet_length("side") + 64)).first()[0] or 0
    spark = rows.sparkSession
    if size <= limit:
        known = spark.sparkContext.broadcast({r.host: r.side for r in sides.collect()})

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict = {}
            for b in batches:
                yield run(b, [known.value.get(h) for h in b.column("host").to_pylist()], state)

        return rows.mapInArrow(flat, schema)
    # large: the hosts whose pages are split, at most LARGE of them
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(F.broadcast(large), "host", "left").withColumn("salt", F.pmod(F.xxhash64("key"), salts)).drop("salts")
    right = sides.join(F.broadcast(large), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    both = left.unionByName(right, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("side").isNull())

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        side = (None, None)
        for b in batches:
            found, take = [], []
            for i, (h, s) in enumerate(zip(b.column("host").to_pylist(), b.column("side").to_pylist())):
                if s is not None:
                    side = (h, s)
                else:
                    take.append(i)
                    found.append(side[1] if side[0] == h else None)
            yield run(b.take(pa.array(take, pa.int64())), found, state)

    return both.mapInArrow(sorted_, schema)


def _cached(state: dict, kind: str, side: str | None, make: Callable):
    """make(side); the last few are kept, as rows of a host come together or hosts are few."""
    kept = state.setdefault(kind, {})
    if side not in kept:
        if len(kept) >= 256:
            kept.clear()
        kept[side] = make(side)
    return kept[side]


def _text(*cols: str):
    return F.array_join(F.collect_list(F.concat_ws(",", *[F.col(c).cast("string") for c in cols])), ";")


def contents(pages: DataFrame, varies: float = VARIES, rare: float = RARE, least: int = LEAST, limit: int = LIMIT, salted: int = 1024) -> DataFrame:
    """page_id, host, content, template_nodes, content_nodes of every page.

    salted: pages of a host that are never split (more, where the table has over LARGE times as many)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    text = F.coalesce("html", F.lit(""))
    base = own(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), text.alias("html"), host.alias("host"), F.md5(text).alias("key"))

    # the distinct pages, their number by host, and a reference of median size
    once = base.groupBy("host", "key").agg(F.min(F.floor(F.log2(F.char_length("html") + 1.0) * 4).cast("int")).alias("step"))
    steps = once.groupBy("host", "step").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    w = W.partitionBy("host")  # over steps, some dozens a host
    run_ = steps.withColumn("upto", F.sum("n").over(w.orderBy("step"))).withColumn("pages", F.sum("n").over(w))
    hosts = materialize(run_.where("upto >= (pages + 1) div 2").groupBy("host").agg(F.min_by("key", "step").alias("key"), F.first("pages").alias("pages")))
    total = hosts.agg(F.sum("pages"), F.count("*"), F.sum(F.octet_length("host") + 64)).first()
    part = max(salted, -(-(total[0] or 0) // LARGE))
    large = hosts.where(F.col("pages") > part).select("host", F.ceil(F.col("pages") / part).alias("salts"))
    chosen = hosts.select("host", "key")
    chosen = F.broadcast(chosen) if (total[2] or 0) <= limit else chosen
    refs = materialize(base.select("host", "key", "html").join(chosen, ["host", "key"], "left_semi").groupBy("host").agg(F.min("html").alias("side")))

    def read(b: pa.RecordBatch, sides: list, state: dict) -> pa.RecordBatch:
        slots, hashes = [], []
        for page, ref in zip(b.column("html").to_pylist(), sides):
            places = list(dict.fromkeys(_cached(state, "reader", ref, Reader)(page)[0]))
            slots.append([p[0] for p in places])
            hashes.append([p[1] for p in places])
        return pa.RecordBatch.from_arrays([b.column("host"), b.column("key"), pa.array(slots, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "key", "slots", "hashes"])

    kind = "host string, key string, slots array<long>, hashes array<long>"
    seen = _beside(base.select("host", "key", "html"), refs, large, read, kind, limit)
    places = materialize(seen.groupBy("host", "key").agg(F.first("slots").alias("slots"), F.first("hashes").alias("hashes")))

    # texts by the number of pages they are on; those of large hosts don't meet in one task
    counts = places.select("host", F.inline(F.arrays_zip("slots", "hashes"))).toDF("host", "slot", "hash").groupBy("host", "slot", "hash").agg(F.count("*").alias("n")).where("n >= 2")
    sized = hosts.select("host", "pages")
    big = F.broadcast(sized.where(F.col("pages") > part))
    known = counts.join(big, "host").unionByName(counts.join(big, "host", "left_anti").join(sized.where(F.col("pages") <= part), "host"))
    frequent = (F.col("n") >= least) & (F.col("n") >= rare * F.col("pages"))
    constant = F.col("n") >= (1 - varies) * F.col("pages")
    texts_ = materialize(known.where(frequent | constant))
    freq = texts_.where(frequent).groupBy("host").agg(_text("slot", "hash", "n").alias("freq"))
    const = texts_.where(constant).groupBy("host").agg(_text("slot", "hash", "n").alias("constant"))

    def sides(**parts: DataFrame) -> DataFrame:
        out = sized
        for df in parts.values():
            out = out.join(df, "host", "left")
        return out.select("host", F.to_json(F.struct("pages", *parts)).alias("side"))

    long4 = ["s1", "h1", "s2", "h2"]

    def follow(b: pa.RecordBatch, given: list, state: dict) -> pa.RecordBatch:
        out: list[tuple] = []
        for h, s, x, side in zip(b.column("host").to_pylist(), b.column("slots").to_pylist(), b.column("hashes").to_pylist(), given):
            n = _cached(state, "wrapper", side, Wrapper).n
            some = _frequent(zip(s, x), n)
            out += [(h, *p, *q, n[p]) for p, q in zip(some, some[1:])]
        return _batch(out, ["host", *long4, "most"])

    first = materialize(sides(freq=freq))
    pairs = _beside(places, first, large, follow, "host string, s1 long, h1 long, s2 long, h2 long, most long", limit)
    bonds = pairs.groupBy("host", *long4, "most").agg(F.count("*").alias("m")).where(F.col("m") >= (1 - varies) * F.col("most")).groupBy("host").agg(_text(*long4).alias("bonds"))

    def name(b: pa.RecordBatch, given: list, state: dict) -> pa.RecordBatch:
        out: list[tuple] = []
        for h, s, x, side in zip(b.column("host").to_pylist(), b.column("slots").to_pylist(), b.column("hashes").to_pylist(), given):
            wrapper = _cached(state, "wrapper", side, Wrapper)
            at = list(zip(s, x))
            t = _named(at, wrapper.n, wrapper.bonds)
            if t:
                out += [(h, *t, *p) for p in at if p in wrapper.n]
        return _batch(out, ["host", *long4])

    second = materialize(sides(freq=freq, bonds=bonds))
    members = _beside(places, second, large, name, "host string, s1 long, h1 long, s2 long, h2 long", limit).groupBy("host", *long4).agg(F.count("*").alias("c"))
    own_pages = members.where("s1 = s2 and h1 = h2").select("host", "s1", "h1", F.col("c").alias("of"))
    templates = members.join(own_pages, ["host", "s1", "h1"]).where(F.col("c") >= (1 - varies) * F.col("of")).groupBy("host").agg(_text(*long4).alias("templates"))

    last = sides(freq=freq, bonds=bonds, templates=templates, constant=const)
    # the reference goes before the wrapper, with its length in front
    whole = materialize(last.join(refs.withColumnRenamed("side", "ref"), "host").select("host", F.concat(F.char_length("ref").cast("string"), F.lit(":"), "ref", "side").alias("side")))
    discard(refs, places, texts_, first, second)  # what the result reads is in `whole` and `hosts`

    def apply(b: pa.RecordBatch, given: list, state: dict) -> pa.RecordBatch:
        done = []
        for page, side in zip(b.column("html").to_pylist(), given):
            reader, wrapper = _cached(state, "both", side, _split)
            done.append(wrapper(*reader(page)))
        cols = list(zip(*done)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["page_id", "host", "content", "template_nodes", "content_nodes"])

    return _beside(base, whole, large, apply, "page_id long, host string, content string, template_nodes int, content_nodes int", limit)


def _split(side: str | None) -> tuple[Reader, Wrapper]:
    n, _, rest = (side or "0:").partition(":")
    return Reader(rest[: int(n)]), Wrapper(rest[int(n) :])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(cols)], names=names)
