"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws -ln(u) / weight from a hash of the document's key and the
child's path, and the smallest draw wins.  A child's draw depends on nothing but the key,
its own path and its own weight, so a change of weights moves documents only from or to subtrees whose
weight changed.  The weight of an inner node is the sum of its shards', so the share of each shard
is its share of all weights.

A projection in whole-stage code: no shuffle, no Python, and no state but the tree.

Defined results: the key is doc_id, where that is null the text's md5, and '' where both are;
equal keys go together; of equal draws the child that is named first wins; an empty table gives no rows; children of weight 0 get nothing; a tree without positive weights is an
error; columns named region, rack or shard are replaced, others carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("region", "rack", "shard")
Tree = dict[str, dict[str, dict[str, float]]]

#: Three regions of four racks of four shards; one region's disks are twice as large, and one rack is half full.
TREE: Tree = {f"r{r}": {f"k{k}": {f"s{s}": (2.0 if r == 0 else 1.0) * (0.5 if (r, k) == (2, 3) else 1.0) for s in range(4)} for k in range(4)} for r in range(3)}


def weight_of(node) -> float:
    return sum(map(weight_of, node.values())) if isinstance(node, dict) else float(node)


def _paths(tree: Tree) -> list[tuple[str, ...]]:
    """Each inner node's path, the root's first."""
    return [(), *((r,) for r in tree), *((r, k) for r in tree for k in tree[r])]


def _children(tree: Tree, path: tuple[str, ...]) -> dict[str, float]:
    node = tree
    for p in path:
        node = node[p]
    return {name: weight_of(x) for name, x in node.items() if weight_of(x) > 0}


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))


def _draw(key: Column, path: tuple[str, ...], name: str, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + "/".join((*path, name))))), 1, 12), 16, 10).cast("double")
    return -F.log((h + 1) / F.lit(2.0**48)) / F.lit(weight)


def _choose(key: Column, tree: Tree, path: tuple[str, ...]) -> Column:
    drawn = [F.struct(_draw(key, path, n, w).alias("draw"), F.lit(n).alias("name")) for n, w in _children(tree, path).items()]
    return (F.least(*drawn) if len(drawn) > 1 else drawn[0])["name"]


def assign(docs: DataFrame, tree: Tree = TREE) -> DataFrame:
    """docs with region, rack and shard."""
    if weight_of(tree) <= 0:
        raise ValueError("no shard has a positive weight")
    out = docs.drop(*[c for c in docs.columns if c.lower() in LEVELS])
    names: list[str] = []
    for level in LEVELS:
        pick = F.lit(None).cast("string")
        for path in [p for p in _paths(tree) if len(p) == len(names) and _children(tree, p)]:
            here = F.lit(True)
            for name, value in zip(names, path):
                here = here & (F.col(name) == value)
            pick = F.when(here, _choose(_key(), tree, path)).otherwise(pick) if names else _choose(_key(), tree, path)
        out = out.withColumn(level, pick)
        names.append(level)
    return out


def moved(docs: DataFrame, old: Tree, new: Tree) -> DataFrame:
    """doc_id and both places of the documents that a change of the tree moves."""
    a = assign(docs.select("doc_id", "text"), old)
    b = assign(a.select("doc_id", "text", *[F.col(c).alias(f"old_{c}") for c in LEVELS]), new)
    differs = F.lit(False)
    for c in LEVELS:
        differs = differs | (F.col(c) != F.col(f"old_{c}"))
    return b.where(differs).drop("text")


def sql(tree: Tree = TREE, table: str = "documents") -> str:
    """The same descent in SQL: one row for each child drawn, the smallest draw of each level kept."""
    rows = [(("/".join(p)), n, "/".join((*p, n)), w) for p in _paths(tree) for n, w in _children(tree, p).items()]
    values = ", ".join(f"('{a}', '{b}', '{c}', {w}::DOUBLE)" for a, b, c, w in rows)
    draw = "-ln((('0x' || substr(md5(key || ':' || path), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0::DOUBLE) / weight"
    steps, before, cols = [], "docs", ""
    for i, level in enumerate(LEVELS):
        at = "''" if i == 0 else "region" if i == 1 else "region || '/' || rack"
        steps.append(f"l{i} AS (SELECT rid, key, doc_id{cols}, arg_min(name, {draw}) AS {level} FROM {before} JOIN tree ON parent = {at} GROUP BY rid, key, doc_id{cols})")
        before, cols = f"l{i}", f"{cols}, {level}"
    return f"""
WITH tree(parent, name, path, weight) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, md5(text), '') AS key FROM {table}),
{', '.join(steps)}
SELECT doc_id, region, rack, shard FROM l2"""
