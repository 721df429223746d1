"""Connected components of an edge table by alternating star contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsleuth.sources.shared import shared_dir, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root of each node that has an edge; edges: a, b (long). root is the least node reachable.

    Each round makes every node's larger neighbours point to its least one, then every node to the least
    of its smaller ones (large and small star); the number of rounds is logarithmic in practice. A round
    is an aggregation for the least neighbour and a join, both on the node; each is written to the shared
    folder, so that a lost executor costs no earlier round. Self loops and repeated edges do no harm; an
    empty table has no components.
    """
    spark = edges.sparkSession
    base = shared_dir(spark)
    pairs = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{base}/0")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u"))) if large else pairs
        both = both.toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            new = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return new.where(F.col("u") != F.col("v")).distinct()

    def fingerprint(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = fingerprint(pairs)
    for k in range(1, max_rounds):
        if not before[0]:
            break
        pairs = written(star(star(pairs, True), False), f"{base}/{k}")
        now = fingerprint(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
