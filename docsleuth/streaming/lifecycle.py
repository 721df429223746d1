"""L15 as a stream: assessments become case events, each micro-batch once.

A batch's events are written to a folder of the batch's number, then the number goes to a ledger; only batches of the ledger count. Spark repeats a
batch, with the same number and rows, if it failed before its commit: without a ledger entry its folder is written anew, with
one nothing happens. The state of cases that a batch meets is the one given at first, after the events of all batches before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.operators import cases
from docsleuth.sources.shared import exists

EVENT = "case_key string, status string, disposition string, priority string, generated_at string"


class LifecycleSink:
    """The function for foreachBatch; base is a folder that driver and executors share.

    At every `compact_every` batches the state is written as a whole, so that a batch reads no more than that many before it.
    """

    def __init__(self, state: DataFrame, base: str, order: str = "generated_at", compact_every: int = 20):
        self.initial = state.select("case_key", "disposition")
        self.base, self.order, self.compact_every = base, order, compact_every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in self.committed(spark):
            return
        known = self.state(spark, batch_id)
        path = f"{self.base}/events/{batch_id}"
        found = cases.lifecycle_in_order(batch, known, self.order)
        found.select("case_key", "status", "disposition", "priority", F.col(self.order).cast("string").alias("generated_at")).write.mode("overwrite").parquet(path)
        if (batch_id + 1) % self.compact_every == 0:
            after = self._folded(known, self._events(spark, [batch_id]))
            after.write.mode("overwrite").parquet(f"{self.base}/states/{batch_id}")
        # last of all: what the ledger names is whole
        n = spark.read.schema(EVENT).parquet(path).count()
        spark.createDataFrame([(batch_id, n)], "batch_id bigint, n_events bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/ledger/{batch_id}")

    def committed(self, spark: SparkSession) -> dict[int, int]:
        """Numbers of the batches that are whole, and of their events."""
        if not exists(spark, f"{self.base}/ledger"):
            return {}
        rows = spark.read.schema("batch_id bigint, n_events bigint").option("recursiveFileLookup", True).parquet(f"{self.base}/ledger").collect()
        return {r["batch_id"]: r["n_events"] for r in rows}

    def _events(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        read = spark.read.schema(EVENT)
        if not batches:
            return spark.createDataFrame([], EVENT).withColumn("batch_id", F.lit(0).cast("bigint"))
        # the folder's name is the batch's number
        found = read.parquet(*[f"{self.base}/events/{b}" for b in batches])
        return found.withColumn("batch_id", F.element_at(F.split(F.input_file_name(), "/"), -2).cast("bigint"))

    def events(self, spark: SparkSession) -> DataFrame:
        """case_key, status, disposition, priority, generated_at, batch_id of all whole batches."""
        return self._events(spark, sorted(self.committed(spark)))

    def _folded(self, known: DataFrame, events: DataFrame) -> DataFrame:
        before = known.select("case_key", "disposition", F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit("").alias("t")).alias("at"))
        after = events.select("case_key", "disposition", F.struct(F.col("batch_id").alias("b"), F.col("generated_at").alias("t")).alias("at"))
        return before.unionByName(after).groupBy("case_key").agg(F.max_by("disposition", "at").alias("disposition"))

    def state(self, spark: SparkSession, before: int) -> DataFrame:
        """case_key, disposition as the batch of this number finds them."""
        done = sorted(b for b in self.committed(spark) if b < before)
        whole = max((b for b in done if (b + 1) % self.compact_every == 0), default=None)
        if whole is None and not exists(spark, f"{self.base}/states/first/_SUCCESS"):
            self.initial.write.mode("overwrite").parquet(f"{self.base}/states/first")  # once: every batch starts from the same
        known = spark.read.schema(self.initial.schema).parquet(f"{self.base}/states/{'first' if whole is None else whole}")
        return self._folded(known, self._events(spark, [b for b in done if whole is None or b > whole]))


def run_lifecycle(assessments: DataFrame, sink: LifecycleSink, checkpoint: str) -> None:
    """Runs the stream over what there is; assessments: case_key, risk_level and the sink's order column."""
    assessments.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
