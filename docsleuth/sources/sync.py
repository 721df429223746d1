"""Incremental sync of a folder into snapshots, with copies made in tasks.

A sync lists the source, compares it with the newest whole snapshot by path, length and modification time, copies what is new or changed into
its own version's folder and writes the manifest last. The manifest is the commit point: a version without one counts for nothing, and
the next sync writes it anew. A snapshot names every file of the source with the version that holds its bytes, so unchanged files are
never copied again, and any version can be read as it was. Empty files are left out, as Spark's readers don't list them.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsleuth.sources import files
from docsleuth.sources.shared import exists, names, remove, written

#: status: copied (new), updated (changed), skipped (as before), removed (no longer there), failed (changed while it was copied).
MANIFEST = "path string, length bigint, modified timestamp, status string, sha256 string, held_by bigint"
BLOCK = 8 << 20
#: Bytes of text that a task takes of a file made by write_lines; and of a file that has a task of its own in a sync.
PIECE = 32 << 20
LARGE = 64 << 20


@dataclass(frozen=True)
class Sync:
    version: int
    snapshot: str
    counts: dict[str, int]


def versions(spark: SparkSession, target: str) -> list[int]:
    """The whole snapshots."""
    found = [int(n.removeprefix("v")) for n in names(spark, f"{target}/snapshots")]
    return sorted(v for v in found if exists(spark, f"{_folder(target, v)}/manifest/_SUCCESS"))


def _folder(target: str, version: int) -> str:
    return f"{target}/snapshots/v{version:06d}"


def manifest(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """A snapshot's manifest, the newest by default; empty if there is none."""
    done = versions(spark, target)
    if not done:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{_folder(target, version if version is not None else done[-1])}/manifest")


def _listed(spark: SparkSession, source: str, extensions: list[str] | None) -> DataFrame:
    """Paths below the source, as the part after it."""
    found = files.listing(spark, source, extensions)
    return found.select(files.below(source).alias("path"), "length", F.col("modificationTime").alias("modified"))


def _copied(source: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        reader, root = fs.FileSystem.from_uri(_uri(source))
        writer, out = fs.FileSystem.from_uri(_uri(folder))
        for batch in batches:
            digests, whole = [], []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                digest, n, to = hashlib.sha256(), 0, posixpath.join(out, path)
                writer.create_dir(posixpath.dirname(to), recursive=True)
                with reader.open_input_stream(posixpath.join(root, path)) as a, writer.open_output_stream(f"{to}.part") as b:
                    while block := a.read(BLOCK):
                        digest.update(block)
                        n += b.write(block)
                writer.move(f"{to}.part", to)  # a task that is tried again replaces what it left
                digests.append(digest.hexdigest())
                whole.append(n == length)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(whole, pa.bool_())], names=[*batch.schema.names, "sha256", "whole"])

    return run


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        writer, out = fs.FileSystem.from_uri(_uri(folder))
        writer.create_dir(out, recursive=True)
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                to = posixpath.join(out, name)
                with writer.open_output_stream(f"{to}.part") as f:
                    f.write(value.encode())
                writer.move(f"{to}.part", to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def write_each(rows: DataFrame, folder: str) -> None:
    """A file for each row, of its name and its text (value), written in tasks. A task that is tried again replaces what it left; nothing is renamed by the driver."""
    rows.select("name", "value").mapInArrow(_written(folder), "n bigint").write.format("noop").mode("overwrite").save()


def _pieces(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, out = fs.FileSystem.from_uri(_uri(folder))
        part, found, sink, to = TaskContext.get().partitionId(), [], None, ""

        def closed() -> None:
            if sink:
                sink.close()
                store.move(f"{to}.part", to)  # a task that is tried again replaces what it left

        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if not found or found[-1][0] != name:
                    closed()
                    store.create_dir(posixpath.join(out, name), recursive=True)
                    to = posixpath.join(out, name, f"{part:08d}")
                    sink = store.open_output_stream(f"{to}.part")
                    found.append([name, part, 0])
                found[-1][2] += sink.write(f"{value}\n".encode())
        closed()
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "part", "bytes"])

    return run


def _assembled(pieces: str, folder: str, hidden: str, in_place: bool):
    """Pieces (name, part, at) to their places in hidden files. in_place: any task writes any piece; else a file's pieces come to one task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(pieces))
        out, n, last, sink = fs.FileSystem.from_uri(_uri(folder))[1], 0, None, None
        store.create_dir(out, recursive=True)
        for batch in batches:
            for name, part, at in zip(*[batch.column(c).to_pylist() for c in ("name", "part", "at")], strict=True):
                to = posixpath.join(out, f".{name}.{hidden}")
                if in_place:
                    sink = open(os.open(to, os.O_WRONLY | os.O_CREAT, 0o644), "wb")
                    sink.seek(at)
                elif name != last:
                    if sink:
                        sink.close()
                    last, sink = name, store.open_output_stream(to)
                with store.open_input_stream(posixpath.join(root, name, f"{part:08d}")) as a:
                    while block := a.read(BLOCK):
                        sink.write(block)
                if in_place:
                    sink.close()
                n += 1
        if sink and not in_place:
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _named(folder: str, hidden: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, out = fs.FileSystem.from_uri(_uri(folder))
        for batch in batches:
            for name in batch.column("name").to_pylist():
                made = posixpath.join(out, f".{name}.{hidden}")
                if store.get_file_info(made).type == fs.FileType.File:  # else a task that is tried again has moved it
                    store.move(made, posixpath.join(out, name))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def write_lines(rows: DataFrame, folder: str, order: str, piece: int = PIECE, in_place: bool | None = None) -> None:
    """A file for each name, of its rows' texts (value) as lines in the given order, whatever its size.

    Rows are dealt to ranges of name and order of about so many bytes; a task writes its range as pieces, and where the bytes before them are
    known, tasks put the pieces at their places. So no task reads or writes a file whole. Stores other than file: can't write within a
    file (in_place); there a task appends a file's pieces, a block at a time. A file is moved to its name when it is whole.
    """
    spark, hidden = rows.sparkSession, uuid.uuid4().hex
    pieces = f"{folder.rstrip('/')}.pieces-{hidden}"
    in_place = _uri(folder).startswith("file:") if in_place is None else in_place
    n = -(-(rows.agg(F.sum(F.octet_length("value") + 1).alias("n")).first()["n"] or 0) // piece)
    dealt = rows.select("name", order, "value").repartitionByRange(max(1, n), "name", order).sortWithinPartitions("name", order).select("name", "value")
    made = written(dealt.mapInArrow(_pieces(f"{pieces}/data"), "name string, part bigint, bytes bigint"), f"{pieces}/made")
    # a row for each piece
    at = F.sum("bytes").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    places = made.select("name", "part", at.alias("at"))
    places = places.repartition(max(1, n), "name", "part") if in_place else places.repartition("name").sortWithinPartitions("name", "part")
    places.mapInArrow(_assembled(f"{pieces}/data", folder, hidden, in_place), "n bigint").write.format("noop").mode("overwrite").save()
    made.select("name").distinct().mapInArrow(_named(folder, hidden), "n bigint").write.format("noop").mode("overwrite").save()
    remove(spark, pieces)


def _uri(path: str) -> str:
    """As the file systems of tasks want it: a bare path is a local one."""
    return f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def sync(spark: SparkSession, source: str, target: str, extensions: list[str] | None = None, files_per_task: int = 200) -> Sync:
    """Takes the source's state into a new snapshot below target; both are folders or object prefixes."""
    done = versions(spark, target)
    version = done[-1] + 1 if done else 0
    folder = _folder(target, version)
    before = manifest(spark, target).where("status not in ('removed', 'failed')").select("path", F.col("length").alias("__length"), F.col("modified").alias("__modified"), F.col("sha256").alias("__sha256"), F.col("held_by").alias("__held_by"))
    plan = f"{folder}/plan"
    # written once: a file that changes later must not appear in two states
    same = (F.col("length") == F.col("__length")) & (F.col("modified") == F.col("__modified"))
    status = F.when(F.col("length").isNull(), "removed").when(F.col("__length").isNull(), "copied").when(same, "skipped").otherwise("updated")
    _listed(spark, source, extensions).join(before, "path", "full_outer").withColumn("status", status).write.mode("overwrite").parquet(plan)
    rows = spark.read.parquet(plan)
    fresh = rows.where("status in ('copied', 'updated')").select("path", "length", "modified", "status")
    # each large file has a task of its own: its digest has to be taken in order, so a task streams it, but never two of them
    large = F.col("length") >= LARGE
    n, n_large = fresh.agg(F.count(F.lit(1)), F.count_if(large)).first()
    n_small = max(1, -(-(n - n_large) // files_per_task))
    nth = fresh.where(large).select("*", (F.row_number().over(Window.orderBy("path")) + n_small - 1).alias("__task"))
    dealt = fresh.where(~large).withColumn("__task", F.pmod(F.hash("path"), F.lit(n_small))).unionByName(nth)
    copied = dealt.repartitionById(n_small + n_large, F.col("__task").cast("int")).drop("__task").mapInArrow(_copied(source, f"{folder}/files"), "path string, length bigint, modified timestamp, status string, sha256 string, whole boolean")
    held = copied.select("path", "length", "modified", F.when(F.col("whole"), F.col("status")).otherwise("failed").alias("status"), "sha256", F.lit(version).cast("bigint").alias("held_by"))
    rest = rows.where("status in ('skipped', 'removed')").select("path", F.coalesce("length", "__length").alias("length"), F.coalesce("modified", "__modified").alias("modified"), "status", F.col("__sha256").alias("sha256"), F.col("__held_by").alias("held_by"))
    held.unionByName(rest).write.mode("overwrite").parquet(f"{folder}/manifest")
    counts = {r["status"]: r["count"] for r in manifest(spark, target, version).groupBy("status").count().collect()}
    return Sync(version, folder, counts)


def stored(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """path, stored (where its bytes are), length, sha256 of the files in a snapshot."""
    at = F.concat(F.lit(f"{target}/snapshots/v"), F.lpad(F.col("held_by").cast("string"), 6, "0"), F.lit("/files/"), F.col("path"))
    return manifest(spark, target, version).where("status not in ('removed', 'failed')").select("path", at.alias("stored"), "length", "sha256")
