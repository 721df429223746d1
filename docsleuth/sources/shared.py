"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, where that is unset and Spark is local (tests), below a local one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        base = context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/docsleuth-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written once to the shared folder and read from there: later jobs neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_by_one(df: DataFrame) -> DataFrame:
    """df, whose rows the next step takes one by one.

    A compiled stage holds all rows that a row of its input grows to, through all of its joins and explodes, before it hands on the first.
    An observed table isn't compiled, so it ends such a stage: what is held is what one step makes of a row.
    """
    return df.observe(f"rows_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any store that Spark reads."""
    found, store = _path(spark, path)
    return store.exists(found)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds directly; nothing if there is no such folder."""
    found, store = _path(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(found)) if store.exists(found) else []


def remove(spark: SparkSession, path: str) -> None:
    found, store = _path(spark, path)
    store.delete(found, True)


def placed(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the only part file of a folder that Spark wrote to a path of its own; what was there goes."""
    part = next(n for n in names(spark, folder) if n.startswith("part-"))
    found, store = _path(spark, path)
    store.delete(found, False)
    store.mkdirs(found.getParent())
    if not store.rename(_path(spark, f"{folder}/{part}")[0], found):
        raise OSError(f"could not move {folder} to {path}")
