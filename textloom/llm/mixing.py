"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The corpus is cut into shards of about `shard_tokens` tokens by a seeded hash of doc_id.  In
each shard the documents of a source, in seeded order, are one stream of tokens, cut into
blocks of `block_tokens`; a document belongs to the block of its first token.  Of a shard's
blocks `share` are to be chosen: the j-th block of a source (in seeded order, from 0) has the
quotient weight / (2 j + 1), and the blocks with the highest quotients are taken.  So every
source has an integer quota in every shard, never more than it has blocks; what a scarce
source can't fill goes to the others by the same quotients.  Ties go to the source that sorts first.

A shard is of bounded size however large the corpus or a source, and so is each window.

With a large `share` most blocks are seated whatever the weights, so the mix can stay far from its targets, and a document
longer than a block takes one seat, so blocks can hold more tokens than `block_tokens`: mixture() gives, for each
source, its target beside the share it gets, in seats and in tokens.

A token is a run of characters other than space, tab, line feed and carriage return.

Defined results: a null source is a source of its own, under the name ''; sources without a weight have
`other`; a weight of 0 or less excludes a source; null and empty texts have 0 tokens and go
with the block they fall in; a text longer than a block takes the one seat of its first token's block, whatever it runs through; a null doc_id hashes as ''; of equal rows all are kept if any is;
extra columns are carried along by mix_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._util import discard, fresh, materialize

WEIGHTS = {"src0": 2.0}
OTHER, SHARE, BLOCK, SHARD, SEED = 1.0, 0.9, 4096, 4_000_000, 7


def _draw(*parts: Column | str) -> Column:
    """A seeded 32-bit number, the same in SQL."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def allocate(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, share: float = SHARE, block_tokens: int = BLOCK, shard_tokens: int = SHARD, seed: int = SEED) -> DataFrame:
    """row_key, doc_id, source, n_tokens, shard, block, quota of the documents chosen; quota is the blocks of the source in the shard."""
    tokens = F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")
    slim = materialize(
        docs.select(
            F.xxhash64("doc_id", "source", "text").alias("row_key"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce("source", F.lit("")).alias("source"),
            tokens.alias("n_tokens"),
            _draw(f"mix{seed}", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"),
        )
    )
    total = slim.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    weight = F.lit(float(other))
    for s, v in weights.items():
        weight = F.when(F.col("source") == s, float(v)).otherwise(weight)
    stream = W.partitionBy("shard", "source").orderBy("draw", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = slim.withColumn("shard", F.col("draw") % shards).withColumn("block", F.floor((F.sum("n_tokens").over(stream) - F.col("n_tokens")) / block_tokens).cast("long"))
    # rank of blocks by quotient, on one row for each block
    blocks = laid.groupBy("shard", "source", "block").agg(F.count("*").alias("n")).drop("n")
    by_draw = W.partitionBy("shard", "source").orderBy(_draw(f"block{seed}", F.col("shard").cast("string"), F.col("source"), F.col("block").cast("string")), "block")
    ranked = blocks.withColumn("weight", weight).withColumn("j", F.row_number().over(by_draw) - 1).withColumn("quotient", F.col("weight") / (2 * F.col("j") + 1))
    by_quotient = W.partitionBy("shard").orderBy(F.desc("quotient"), "source", "j")
    taken = ranked.withColumn("nth", F.row_number().over(by_quotient)).withColumn("seats", F.ceil(F.count("*").over(W.partitionBy("shard")) * F.lit(float(share)))).where("nth <= seats and weight > 0")
    taken = taken.select("shard", "source", "block", F.count("*").over(W.partitionBy("shard", "source")).alias("quota"))
    out = laid.join(taken, ["shard", "source", "block"]).select("row_key", "doc_id", "source", "n_tokens", "shard", "block", "quota")
    return out


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents chosen, with all their columns."""
    (key,) = fresh(docs, "key")
    chosen = allocate(docs, **params).select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "source", "text")).join(chosen.hint("shuffle_hash"), key, "left_semi").drop(key)


def mixture(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, **params) -> DataFrame:
    """source, target, seat_share, token_share, kept: what each source of docs should have of the mix, has in seats and in tokens, and the share of its own tokens that stays."""
    every = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long").alias("n_tokens")).groupBy("source").agg(F.sum("n_tokens").alias("had"))
    chosen = allocate(docs, weights, other, **params)
    # a seat is a block, of one row or many
    seats = chosen.groupBy("source").agg(F.count_distinct("shard", "block").alias("seats"), F.sum("n_tokens").alias("tokens"))
    weight = F.lit(float(other))
    for s, v in weights.items():
        weight = F.when(F.col("source") == s, float(v)).otherwise(weight)
    joined = every.join(seats, "source", "left").withColumn("weight", F.greatest(weight, F.lit(0.0)))
    share = lambda c: F.coalesce(F.col(c) / F.sum(c).over(W.partitionBy()), F.lit(0.0))  # noqa: E731 - one row a source
    return joined.select("source", share("weight").alias("target"), share("seats").alias("seat_share"), share("tokens").alias("token_share"), F.coalesce(F.col("tokens") / F.nullif("had", F.lit(0)), F.lit(0.0)).alias("kept"))


def sql(weights: dict[str, float] = WEIGHTS, other: float = OTHER, share: float = SHARE, block_tokens: int = BLOCK, shard_tokens: int = SHARD, seed: int = SEED, table: str = "documents") -> str:
    case = "CASE source " + " ".join(f"WHEN '{s}' THEN {float(v)}::DOUBLE" for s, v in weights.items()) + f" ELSE {float(other)}::DOUBLE END"
    return f"""
WITH slim AS (
  SELECT doc_id, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens,
    ('0x' || substr(md5('mix{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
  FROM {table}),
shards AS (SELECT greatest(1, ceil(sum(n_tokens) / {shard_tokens}.0))::BIGINT AS n FROM slim),
laid AS (
  SELECT *, floor((sum(n_tokens) OVER (PARTITION BY shard, source ORDER BY draw, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens) / {block_tokens}.0)::BIGINT AS block
  FROM (SELECT slim.*, draw % (SELECT n FROM shards) AS shard FROM slim)),
blocks AS (SELECT DISTINCT shard, source, block FROM laid),
ranked AS (
  SELECT *, {case} AS weight,
    row_number() OVER (PARTITION BY shard, source ORDER BY ('0x' || substr(md5('block{seed}:' || shard || ':' || source || ':' || block), 1, 8))::BIGINT, block) - 1 AS j
  FROM blocks),
seated AS (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * j + 1) DESC, source, j) AS nth,
    ceil(count(*) OVER (PARTITION BY shard) * {float(share)}::DOUBLE) AS seats
  FROM ranked),
taken AS (SELECT shard, source, block, count(*) OVER (PARTITION BY shard, source) AS quota FROM seated WHERE nth <= seats AND weight > 0)
SELECT doc_id, source, n_tokens, shard, block, quota FROM laid JOIN taken USING (shard, source, block)"""
