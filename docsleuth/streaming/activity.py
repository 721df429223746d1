"""Late and repeated records: each counts once, and sessions close when the watermark has passed their last gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP, DELAY = "5 minutes", "10 minutes"


def once(records: DataFrame, ids: list[str], ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Every record once, though it may come again within the delay; what comes later than that is left out. Its state is bounded by the delay."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids)


def sessions(records: DataFrame, keys: list[str], ids: list[str], ts: str = "ts", gap: str = GAP, delay: str = DELAY, measures: dict[str, Column] | None = None) -> DataFrame:
    """keys, start, end, n and the measures of each session: records of the keys that lie less than the gap apart. The end is the last record's time and the gap.

    A stream appends a session when its watermark passes the end; a table gives all of them.
    """
    own = once(records, ids, ts, delay) if records.isStreaming else records.dropDuplicates(ids)
    found = own.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (measures or {}).items()])
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *(measures or {}))
