"""Sources and sinks: document folders, manifests, JSON, logs, labels, relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.sources import schemas

DEFAULT_EXTENSIONS = [".pdf", ".json", ".png", ".jpg", ".jpeg", ".txt"]


def normalized_extensions(extensions: list[str] | None) -> list[str]:
    """S02."""
    found = [e.strip().lower() for e in extensions or [] if e.strip()]
    return [e if e.startswith(".") else f".{e}" for e in found] or DEFAULT_EXTENSIONS


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def listing(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """Path, length, modificationTime, extension of the files below a folder or object prefix; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).drop("content")
    return found.withColumn("extension", extension(F.col("path"))).where(F.col("extension").isin(*normalized_extensions(extensions)))


def prefix_uri(bucket: str, prefix: str = "", scheme: str = "s3a") -> str:
    """S04."""
    return f"{scheme}://{bucket.strip('/')}/{prefix.strip('/')}".rstrip("/")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Size, SHA-256 and signature markers of each file."""
    raw = F.decode("content", "ISO-8859-1")
    marks = [("/Type/Sig", r"/Type\s*/Sig"), ("/FT/Sig", r"/FT\s*/Sig"), ("/ByteRange", r"/ByteRange"), ("/Contents", r"/Contents")]
    found = F.array_compact(F.array(*[F.when(raw.rlike(p), F.lit(n)) for n, p in marks]))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.when(raw.startswith("%PDF-"), F.substring(raw, 6, 3)).alias("pdf_version"), found.alias("signature_markers"))


def manifest(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Paths of a JSON list or {"paths": []}, a CSV with path, file or document, or plain lines; known keeps only listed ones."""
    if path.lower().endswith(".json"):
        raw = spark.read.option("wholetext", True).text(path)
        listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json("value", "paths array<string>")["paths"])
        out = raw.select(F.explode(listed).alias("path"))
    elif path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        names = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("path", "file", "document") if c in rows.columns]
        out = rows.select(F.coalesce(*names, F.lit(None).cast("string")).alias("path"))
    else:
        out = spark.read.text(path).select(F.trim("value").alias("path"))
    out = out.where("path is not null and path != ''").distinct()
    return out.join(known.select(F.regexp_replace("path", "^file:/*", "/").alias("path")), "path", "left_semi") if known is not None else out


def unseen(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger of an earlier sync doesn't hold in this state."""
    return found.join(ledger.select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_anti")


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, a JSON file each."""
    return spark.read.schema(schemas.RAW).option("multiLine", True).json(path).withColumn("source_name", F.col("_metadata.file_name"))


def structured_documents(spark: SparkSession, folder: str) -> DataFrame:
    """S07."""
    return spark.read.schema(schemas.STRUCTURED).option("multiLine", True).option("pathGlobFilter", "*_structured.json").option("recursiveFileLookup", True).json(folder)


def logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines; a line that is none becomes a RAW record."""
    rows = spark.read.text(path).where("trim(value) != ''")
    parsed = rows.withColumn("r", F.from_json("value", schemas.LOG))
    bad = F.col("r.ts").isNull() & F.col("r.level").isNull() & F.col("r.msg").isNull()
    fields = [f.split(" ")[0] for f in schemas.LOG.split(", ")]
    out = parsed.select(*[F.when(bad, {"level": F.lit("RAW"), "msg": F.col("value")}.get(f, F.lit(None))).otherwise(F.col(f"r.{f}")).alias(f) for f in fields])
    return out.fillna("", ["ts", "level", "logger", "module", "func", "msg", "exc"])


def labels(spark: SparkSession, path: str) -> DataFrame:
    """S14."""
    return spark.read.schema(schemas.LABELS).option("header", True).csv(path).withColumn("tamper_types", F.split("tamper_types", r"\|"))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """S13."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{base}/{name}")


def write_table(df: DataFrame, base: str, name: str, mode: str = "overwrite") -> None:
    fields = [f.split(" ")[0] for f in schemas.TABLES[name].split(", ")]
    df.select(*fields).write.mode(mode).parquet(f"{base}/{name}")


def preview(spark: SparkSession, base: str, name: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The newest rows of an allow-listed table without its blobs, and its row count."""
    if name not in schemas.TABLES:
        raise ValueError(f"no such table: {name}")
    df = table(spark, base, name)
    return df.drop("pdf_report").orderBy(F.desc(schemas.NEWEST[name])).limit(limit), df.agg(F.count(F.lit(1)).alias("n"))


def write_reports(df: DataFrame, path: str) -> None:
    """JSON reports by risk level."""
    df.write.mode("append").partitionBy("risk_level").json(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """S17."""
    (df.write.option("header", True).csv if kind == "csv" else df.write.json)(path)


def below(root: str, path: str = "path") -> Column:
    """The part of a path after the root folder's."""
    inside = root.split(":", 1)[-1].strip("/") + "/"
    return F.substr(F.col(path), F.instr(F.col(path), inside) + len(inside))


def inventory(found: DataFrame, depth: int = 1, root: str = "") -> DataFrame:
    """Objects, bytes and MB below each prefix of so many parts, counted from the root."""
    path = below(root) if root.strip("/") else F.regexp_replace("path", "^[a-z0-9]+:/+", "")
    prefix = F.substring_index(path, "/", depth)
    return found.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).withColumn("mb", F.round(F.col("bytes") / 1048576, 2))


def is_audit_source(key: Column) -> Column:
    """Source documents, without generated reports."""
    return ~F.lower(key).rlike(r"_report\.pdf$") & ~F.contains(key, F.lit("/case_reports/"))
