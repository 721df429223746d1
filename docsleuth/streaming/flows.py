"""Stateless scoring, intake and log windows as streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.operators import extract, rules


def intake(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    """New JSON documents of a folder; the checkpoint remembers the seen ones."""
    return spark.readStream.schema(schema).options(multiLine="true", recursiveFileLookup="true", **options).json(folder)


def score_stream(summaries: DataFrame, as_of=None, types: list[str] | None = None, with_signals: bool = True) -> DataFrame:
    """The batch rules over a stream of summaries; they keep no state."""
    return rules.assess(summaries, as_of, types=types, with_signals=with_signals)


def classify_stream(documents: DataFrame, name: str = "source_name", text: str = "text") -> DataFrame:
    return documents.withColumn("c", extract.classify(F.col(name), F.col(text))).select("*", "c.*").drop("c")


def log_volume(logs: DataFrame, ts: str = "ts", delay: str = "5 minutes") -> DataFrame:
    """Records a minute and level."""
    timed = logs.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay) if logs.isStreaming else logs.withColumn("__ts", F.col(ts).cast("timestamp"))
    return timed.groupBy(F.window("__ts", "1 minute").alias("w"), "level").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), "level", "n")


def live_errors(logs: DataFrame, ts: str = "ts", delay: str = "5 minutes") -> DataFrame:
    """Errors in sliding ten minutes."""
    timed = logs.withColumn("__ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("__ts", delay) if logs.isStreaming else timed
    return timed.groupBy(F.window("__ts", "10 minutes", "1 minute").alias("w")).agg(F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("n_errors"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n_errors", "n")


def run_once(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str, schema: str | None = None) -> DataFrame:
    """Runs a stream over what there is and returns its sink as a table; of windows it holds those that the watermark has closed."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State stores that keyed processors need, while a stream starts and runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
