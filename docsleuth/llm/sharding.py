"""Rendezvous hashing of stable record keys over weighted shards.

Every key ranks all shards by -weight / ln(u), u a uniform number drawn from the key and the shard's number
alone, and goes to the first. So a new shard takes only the keys that rank it first, and no other key moves.
Everything is built-in expressions; the only shuffles count and number rows within blocks of a shard.

A null key counts as the text "null". Rows with equal keys share a shard; among them slots are dealt in
the order of size and checksum, and in no fixed order where those are equal too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsleuth.llm.common import utf8, written

SHARDS = 40
#: Each shard's rows are numbered in this many blocks of hashed keys; their counts, shards x BLOCKS rows, are what may be broadcast.
BLOCKS = 1024


def uniform(key: Column, shard: int) -> Column:
    """In (0, 1), from 52 bits of the MD5 of key:shard."""
    return (F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _score(key: Column, shard: int, weight: float) -> Column:
    return F.lit(-float(weight)) / F.log(uniform(key, shard))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the key's shard; a weight of zero keeps a shard empty."""
    ranked = F.array(*[F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0])
    return (-F.array_max(ranked)["shard"]).cast("int")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, grown_by: float = 1.0) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    size is the text's UTF-8 bytes plus 16, text_crc32 their unsigned checksum; slot numbers each shard's rows
    without gaps; grown_shard is the shard once one more, of weight grown_by, has joined.
    """
    key, n = F.col("id"), len(weights)
    rows = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    ranked = F.array_max(F.array(*[F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]))
    placed = (
        rows.select("id", (F.length("text") + 16).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), ranked.alias("best"), _score(key, n, grown_by).alias("more"))
        .select("id", "size", "text_crc32", (-F.col("best.shard")).cast("int").alias("shard"), F.when(F.col("more") > F.col("best.score"), F.lit(n)).otherwise(-F.col("best.shard")).cast("int").alias("grown_shard"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int"))
    )
    placed = written(placed)  # a few numbers a row; counting and numbering would otherwise rank all shards twice
    counts = placed.groupBy("shard", "block").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "block", before.alias("offset"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "size", "text_crc32")))
    return numbered.join(offsets, ["shard", "block"]).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at") - 1).alias("slot"), "grown_shard")
