"""Clusters of records that share attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsleuth.operators.graph import components
from docsleuth.sources.shared import written


def shared_clusters(df: DataFrame, node: str, attributes: list[str]) -> DataFrame:
    """Node, cluster (the least node reachable over shared attribute values).

    Every node of a value is tied to the value's least node, so a value that very many nodes share costs a row each, not
    pairs; the components of these ties are the clusters, however long their chains. Null and empty values tie nothing.
    """
    values = [F.struct(F.lit(a).alias("k"), F.col(a).cast("string").alias("v")) for a in attributes]
    held = written(df.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.explode(F.array(*values)).alias("e")).where("e.v is not null and e.v != ''").select("node", "e.k", "e.v").distinct())
    least = held.groupBy("k", "v").agg(F.min("node").alias("least"))
    found = components(held.join(least, ["k", "v"]).select(F.col("node").alias("a"), F.col("least").alias("b")))
    every = df.where(F.col(node).isNotNull()).select(F.col(node).alias("id")).distinct()
    return every.join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("root", "id").alias("cluster"))
