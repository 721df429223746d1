"""Exact order statistics of groups of any size: a mergeable sketch gives a bracket, one pass counts beyond it, and only what lies inside is ordered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is at most one in so many; the bracket is as wide on either side.
ACCURACY = 1000


def top(df: DataFrame, keys: list[str], value: str, k: Callable[[Column], Column], around: float, accuracy: int = ACCURACY) -> DataFrame:
    """keys, n (values that aren't null), k, kth (the k-th largest value), top_sum (of the k largest). Exact; groups without values have no row.

    k: of n the wanted number, 1 to n; around: the quantile near which the k-th largest lies. Sketches are combined before
    their shuffle. A bracket that misses (a wrong `around`) is widened to all values, so it costs time but no exactness.
    """
    own = [f"__key{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(o) for c, o in zip(keys, own, strict=True)], F.col(value).alias("v"))
    low, high = max(0.0, around - 2 / accuracy), min(1.0, around + 2 / accuracy)
    bracket = rows.groupBy(*own).agg(F.count("*").alias("n"), F.percentile_approx("v", [low, high], accuracy).alias("q")).withColumn("k", k(F.col("n")).cast("bigint"))

    def with_group(groups: DataFrame) -> DataFrame:
        """The rows beside what is known of their group; null keys are a group too."""
        hit = F.lit(True)
        for o in own:
            hit &= F.col(f"r.{o}").eqNullSafe(F.col(f"g.{o}"))
        return rows.alias("r").join(groups.alias("g"), hit).select("r.*", *[F.col(f"g.{c}") for c in groups.columns if c not in own])

    v, lo, hi = F.col("v"), F.col("q")[0], F.col("q")[1]
    known = [F.first(c).alias(c) for c in ("n", "k", "q")]
    beyond = with_group(bracket).groupBy(*own).agg(*known, F.count_if(v > hi).alias("above"), F.count_if(v >= lo).alias("within"), F.coalesce(F.sum(F.when(v > hi, v)), F.lit(0)).alias("sum_above"))
    # a bracket without the k-th largest is none: nothing lies above it, and all inside
    found = (F.col("above") < F.col("k")) & (F.col("within") >= F.col("k"))
    beyond = beyond.select(*own, "n", "k", F.when(found, F.col("q")).alias("q"), F.when(found, F.col("above")).otherwise(0).alias("above"), F.when(found, F.col("sum_above")).otherwise(0).alias("sum_above"))
    inside = with_group(beyond).where(F.col("q").isNull() | v.between(lo, hi))
    # equal values are one row
    values = inside.groupBy(*own, "v").agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n", "k", "above", "sum_above")])
    before = F.sum("c").over(Window.partitionBy(*own).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c") + F.col("above")
    taken = values.withColumn("before", before).where("before < k").withColumn("take", F.least("c", F.col("k") - F.col("before")))
    out = taken.groupBy(*own).agg(F.first("n").alias("n"), F.first("k").alias("k"), F.min("v").alias("kth"), (F.first("sum_above") + F.sum(v * F.col("take"))).alias("top_sum"))
    return out.select(*[F.col(o).alias(c) for c, o in zip(keys, own, strict=True)], "n", "k", "kth", "top_sum")


def quantile(df: DataFrame, keys: list[str], value: str, q: float, accuracy: int = ACCURACY) -> DataFrame:
    """keys, n, value: the least value that at least the share q of a group's values doesn't exceed (a discrete quantile). Exact."""
    found = top(df, keys, value, lambda n: n - F.greatest(F.lit(1), F.ceil(F.lit(q) * n)) + 1, around=q, accuracy=accuracy)
    return found.select(*keys, "n", F.col("kth").alias("value"))
