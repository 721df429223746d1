"""How well flags agree with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, flag: Column, truth: Column) -> DataFrame:
    """Counts, detection rate and false positive rate."""
    p, t = flag.cast("boolean"), truth.cast("boolean")
    n = df.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return n.withColumn("detection_rate", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4)).withColumn("false_positive_rate", F.round(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), 4))


def by_type(df: DataFrame, types: str, flag: Column) -> DataFrame:
    """Detection for each kind in a |-separated list."""
    one = df.select(F.explode(F.split(types, r"\|")).alias("type"), flag.alias("flag")).where("type != ''")
    return one.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("detected"))


def error_profile(df: DataFrame, key: str, error: Column) -> DataFrame:
    """M03."""
    return df.groupBy(key).agg(F.count_if(error).alias("errors"), F.count(F.lit(1)).alias("total"))


def evidence_completeness(signals: DataFrame) -> DataFrame:
    """Share of signals with details."""
    return signals.select(F.explode("signals").alias("s")).agg(F.round(F.avg((F.size("s.details") > 0).cast("double")), 4).alias("completeness"))
