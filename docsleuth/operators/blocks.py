"""Statistics of blocked numeric tables: images as pixels, or any series cut into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsleuth.operators import quantiles, similar


def noise_cv(df: DataFrame, image: str, blocks: list[str], value: str) -> DataFrame:
    """Spread of the blocks' standard deviations over their mean; 0 for flat images."""
    one = df.groupBy(image, *blocks).agg(F.stddev_pop(value).alias("s"))
    out = one.groupBy(image).agg(F.stddev_pop("s").alias("spread"), F.avg("s").alias("mean"), F.count(F.lit(1)).alias("n_blocks"))
    return out.select(image, "n_blocks", F.when(F.col("mean") < 1e-6, 0.0).otherwise(F.col("spread") / F.col("mean")).alias("noise_cv"))


def top_residual(df: DataFrame, image: str, value: str, share: float = 0.05) -> DataFrame:
    """Mean of the largest five per cent, scaled to 0-100. The threshold comes from a sketch and an exact pass (quantiles.top), so no task sorts an image."""
    found = quantiles.top(df, [image], value, lambda n: F.greatest(F.lit(1), F.floor(n * share)), around=1 - share)
    return found.select(image, F.least(F.lit(100.0), F.round(F.col("top_sum") / F.col("k") * 3 / 255 * 100, 2)).alias("residual_score"))


def high_error_share(df: DataFrame, image: str, blocks: list[str], value: str) -> DataFrame:
    """Share of blocks whose mean is at least 5 and twice the image's."""
    one = df.groupBy(image, *blocks).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(image)
    marked = one.withColumn("limit", F.greatest(F.lit(5.0), 2 * F.sum("s").over(w) / F.sum("n").over(w)))
    return marked.groupBy(image).agg(F.count_if(F.col("s") / F.col("n") >= F.col("limit")).alias("n_high"), F.count(F.lit(1)).alias("n_blocks"))


def channel_correlation(df: DataFrame, image: str, a: str, b: str, c: str) -> DataFrame:
    """Mean of the three absolute correlations."""
    return df.groupBy(image).agg(((F.abs(F.corr(a, b)) + F.abs(F.corr(a, c)) + F.abs(F.corr(b, c))) / 3).alias("correlation"))


def copy_move(df: DataFrame, image: str, key: str, descriptor: str, x: str, y: str, diagonal: str, radius: int = 40, k: int = 3) -> DataFrame:
    """Similar descriptors (arrays of whole numbers, as bit sets) far apart in one image; per image half the number of such neighbours, 100 at most.

    Of each key point the k nearest of its image count, itself included. Points meet by blocks of their descriptors (similar.nearest), so most pairs of an
    image are never compared. Images without such neighbours have no row.
    """
    point = F.struct(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    near = similar.nearest(df, image, key, descriptor, k, radius)
    places = df.select(F.col(image).alias("__image"), point.alias("p"), F.col(diagonal).alias("__diagonal"))
    at = lambda name: places.select(F.col("__image").alias(image), F.col("p.k").alias(name), F.col("p").alias(f"p_{name}"), F.col("__diagonal").alias(f"diagonal_{name}"))
    placed = near.join(at("a").hint("merge"), [image, "a"]).join(at("b").hint("merge"), [image, "b"])
    apart = F.hypot(F.col("p_a.x") - F.col("p_b.x"), F.col("p_a.y") - F.col("p_b.y")) >= 0.15 * F.col("diagonal_a")
    other = F.col("a") != F.col("b")
    n = F.struct("distance", other.alias("other"), F.col("b").alias("k"), (other & apart).alias("apart"))
    ranked = placed.withColumn("n", n).withColumn("__nth", F.row_number().over(Window.partitionBy(image, "a").orderBy("n"))).where(F.col("__nth") <= k)
    return ranked.where(F.col("n.apart")).groupBy(image).agg(F.least(F.lit(100.0), F.count(F.lit(1)) / 2).alias("copy_move_score"))
