"""The row before, in groups of any size: ranges are ordered apart, and the last row of each range is carried to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsleuth.sources.shared import written


def with_previous(rows: DataFrame, key: str, order: list[str], values: list[str], ranges: int | None = None) -> DataFrame:
    """rows with previous: a struct of the values in the key's row before, by the order (nulls first); null for the first one.

    Rows are dealt to ranges of key and order, so a key with very many rows lies in several ranges and no task holds it whole. What is
    carried between them is a row for each key and range. Rows that agree in key and order stand in any order, as in a window.
    """
    by = [F.col(key), *map(F.col, order)]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    # written as sorted: the number of the range and the row are the same for all that follows
    placed = written(dealt.sortWithinPartitions(*by).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    own = F.struct(*values)
    inside = placed.withColumn("__before", F.lag(own).over(Window.partitionBy(key, "__range").orderBy("__at")))
    last = placed.groupBy(F.col(key).alias("__key"), F.col("__range").alias("__r")).agg(F.max_by(own, "__at").alias("__last"), F.min("__at").alias("__first"))
    carried = last.select("__key", "__r", "__first", F.lag("__last").over(Window.partitionBy("__key").orderBy("__r")).alias("__carried")).where("__carried is not null")
    joined = inside.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__r")) & (F.col("__at") == F.col("__first")), "left")
    return joined.withColumn("previous", F.coalesce("__before", "__carried")).select(*rows.columns, "previous")
