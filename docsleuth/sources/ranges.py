"""S09, S10 for files of any size: a data source that reads byte ranges, so no file has to fit in a row or a task's memory.

Each file gives one partition that streams it for its SHA-256 (which has to be taken in order) and one for each range of bytes, which looks for
markers. A marker that begins in a range may end in the next one: the reader goes on until that is settled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, start bigint, size_bytes bigint, sha256 string, pdf_version string, markers array<string>"
#: What marks a signature in a file.
MARKERS = {"/Type/Sig": rb"/Type\s*/Sig", "/FT/Sig": rb"/FT\s*/Sig", "/ByteRange": rb"/ByteRange", "/Contents": rb"/Contents"}
BLOCK = 4 << 20
_LONGEST = 16
_OPEN = re.compile(rb"/(?:T|Ty|Typ|Type\s*|Type\s*/S?i?|F|FT\s*|FT\s*/S?i?|B|By|Byt|Byte|ByteR|ByteRa|ByteRan|ByteRang|C|Co|Con|Cont|Conte|Conten|Content)?\Z")


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int  # -1: the whole file, for its digest
    end: int


class RangeReader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        out: list[InputPartition] = []
        for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                out.append(Range(f.path, f.size, -1, f.size))
                out += [Range(f.path, f.size, a, min(a + self.size, f.size)) for a in range(0, f.size, self.size)]
        return out or [Range("", -1, -1, -1)]

    def read(self, partition: Range) -> Iterator[tuple]:
        from pyarrow import fs

        if partition.size < 0:
            return
        store = fs.FileSystem.from_uri(self.folder)[0]
        with store.open_input_file(partition.path) as f:
            if partition.start < 0:
                digest, head = hashlib.sha256(), b""
                while block := f.read(BLOCK):
                    head = head or block[:8]
                    digest.update(block)
                version = head[5:8].decode("latin-1") if head.startswith(b"%PDF-") else None
                yield partition.path, -1, partition.size, digest.hexdigest(), version, []
            else:
                yield partition.path, partition.start, partition.size, None, None, marked(f, partition.start, partition.end, partition.size)


def marked(f, start: int, end: int, size: int) -> list[str]:
    """Names of the markers that begin from start to end; no more than a block and an open end is held."""
    found: set[str] = set()
    f.seek(start)
    at, rest = start, b""
    while at < size and (at < end or rest):
        # beyond the range only what an open marker needs
        block = f.read(min(BLOCK, end - at) if at < end else _LONGEST)
        at += len(block)
        text = re.sub(rb"\s+", b" ", rest + block)
        found.update(n for n, p in MARKERS.items() if re.search(p, text))
        tail = _OPEN.search(text[-_LONGEST:])
        rest = tail[0] if tail else b""
        if len(found) == len(MARKERS) or not block:
            break
    return sorted(found)


class ByteRanges(DataSource):
    """Options: path, a folder, and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(self.options["path"], int(self.options.get("range_bytes", 64 << 20)))


def fingerprints(spark: SparkSession, folder: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Path, size_bytes, sha256, pdf_version, signature_markers of each file below the folder; one aggregation puts the ranges together."""
    spark.dataSource.register(ByteRanges)
    rows = spark.read.format("byte_ranges").option("range_bytes", range_bytes).load(folder)
    markers = F.array_sort(F.array_distinct(F.flatten(F.collect_set("markers"))))
    return rows.groupBy("path").agg(F.max("size_bytes").alias("size_bytes"), F.max("sha256").alias("sha256"), F.max("pdf_version").alias("pdf_version"), markers.alias("signature_markers"))
