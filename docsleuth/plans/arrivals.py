"""Queries of what arrives over time: streams that are stopped, resumed and repeated, and folders that are synced again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.operators import cases
from docsleuth.plans import views as V
from docsleuth.plans.registry import query
from docsleuth.sources import sync
from docsleuth.sources.shared import names, remove, shared_dir
from docsleuth.streaming import activity, flows, kyc, lifecycle

_FIRST = """v_known AS (SELECT case_key, disposition FROM v_state WHERE right(case_key, 1) <> '7'),
v_first AS (SELECT r.case_key, arg_min(risk_level, generated_at) AS level, min(generated_at) AS at, any_value(k.case_key) IS NULL AS unseen, any_value(coalesce(k.disposition, 'open')) AS disposition
  FROM v_report r LEFT JOIN v_known k ON r.case_key = k.case_key GROUP BY 1)"""


def repeated_last_batch(spark: SparkSession, checkpoint: str) -> None:
    """Takes back the newest commit of a stopped stream, as if it had failed just before: its next start runs the last batch again."""
    done = [int(n) for n in names(spark, f"{checkpoint}/commits") if n.isdigit()]
    for n in (f"{max(done)}", f".{max(done)}.crc"):
        remove(spark, f"{checkpoint}/commits/{n}")


@query(
    """SELECT r.case_key, CASE WHEN unseen AND level = 'low' THEN 'closed' WHEN risk_level = 'high' THEN 'triage' ELSE 'new' END AS status,
  CASE WHEN unseen AND level = 'low' THEN 'cleared' ELSE 'open' END AS disposition, CASE WHEN risk_level = 'high' AND NOT (unseen AND level = 'low') THEN 'high' ELSE 'normal' END AS priority, generated_at
FROM v_report r JOIN v_first f ON r.case_key = f.case_key
WHERE f.disposition NOT IN ('cleared', 'fraud_confirmed') AND CASE WHEN unseen AND level = 'low' THEN generated_at = f.at ELSE risk_level IN ('high', 'medium') END""",
    f"{V.CASE_EVENTS}, {_FIRST}",
)
def streamed_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """L15 as a stream: assessments come in two arrivals, and the last batch is run again; cases whose key ends in 7 have no state yet."""
    base = shared_dir(spark)
    state = cases.folded(V.case_events(spark, d), columns=["disposition"]).where("right(case_key, 1) <> '7'")
    rows = V.reports(spark, d).select("case_key", "risk_level", "generated_at")
    sink = lifecycle.LifecycleSink(state, f"{base}/cases")
    for part in ("generated_at < '1995'", "generated_at >= '1995'"):
        rows.where(part).write.mode("append").parquet(f"{base}/assessments")
        lifecycle.run_lifecycle(spark.readStream.schema(rows.schema).parquet(f"{base}/assessments"), sink, f"{base}/checkpoint")
    repeated_last_batch(spark, f"{base}/checkpoint")
    lifecycle.run_lifecycle(spark.readStream.schema(rows.schema).parquet(f"{base}/assessments"), sink, f"{base}/checkpoint")
    return sink.events(spark).select("case_key", "status", "disposition", "priority", "generated_at")


_SESSIONS = """v_own AS (SELECT user_id % 37 AS module, ts, event_id, event_type FROM events),
v_session AS (SELECT module, min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS ends, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY module ORDER BY ts, event_id) AS k FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY module ORDER BY ts, event_id) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM v_own)) GROUP BY module, k)"""
_SESSION_ROWS = "SELECT module, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(ends, '%Y-%m-%d %H:%M:%S.%f') AS ends, n, n_errors FROM v_session"


def _session_rows(found: DataFrame) -> DataFrame:
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return found.select("module", F.date_format("start", form).alias("start"), F.date_format("end", form).alias("ends"), "n", "n_errors")


@query(f"{_SESSION_ROWS} WHERE ends + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events)", _SESSIONS)
def streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """2.11: sessions of a module's events under a watermark. The second arrival repeats events, and brings ones that are too late; neither counts."""
    base = shared_dir(spark)
    events = V.table(spark, d, "events").select((F.col("user_id") % 37).alias("module"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    half = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.timestamp_micros(F.expr("(unix_micros(a) + unix_micros(b)) div 2")).alias("half")).first()["half"]
    early, later = events.where(F.col("ts") < F.lit(half)), events.where(F.col("ts") >= F.lit(half))
    # new numbers, but older than the watermark; and the same numbers again, of which the watermark has passed none or all
    late = early.where((F.col("event_id") % 3 == 0) & (F.col("ts") < F.lit(half) - F.expr("INTERVAL 1 HOUR"))).withColumn("event_id", -1 - F.col("event_id"))
    again = events.where(F.col("event_id") % 5 == 0)
    arrivals = [early.unionByName(early.where(F.col("event_id") % 7 == 0)), later.unionByName(late).unionByName(again)]
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/events")
        found = activity.sessions(stream, ["module"], ["event_id"], measures={"n_errors": F.count_if(F.col("event_type") == "error")})
        out = flows.run_once(found, spark, f"{base}/sink", f"{base}/checkpoint")
    return _session_rows(out)


@query(_SESSION_ROWS, _SESSIONS)
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    """2.11: the same over a table, repeated rows included."""
    events = V.table(spark, d, "events").select((F.col("user_id") % 37).alias("module"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    rows = events.unionByName(events.where(F.col("event_id") % 5 == 0))
    return _session_rows(activity.sessions(rows, ["module"], ["event_id"], measures={"n_errors": F.count_if(F.col("event_type") == "error")}))


_FINISHED = """v_n AS (SELECT count(*) AS n FROM embeddings),
v_f AS (SELECT session_id, frame_no, nose_rel_x, split_part(session_id, '-', 1)::BIGINT AS person FROM v_frame),
v_pass AS (SELECT session_id, person, min(frame_no) AS frame_no FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_no) AS nth,
    max(nose_rel_x) OVER (PARTITION BY session_id ORDER BY frame_no ROWS 19 PRECEDING) AS hi FROM v_f) WHERE nth >= 3 AND hi >= 0.62 GROUP BY 1, 2),
v_done AS (SELECT p.*, r.embedding AS reference, list_dot_product(o.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM v_pass p CROSS JOIN v_n
  LEFT JOIN embeddings r ON p.person % 3 <> 0 AND r.vec_id = p.person % n
  LEFT JOIN embeddings o ON o.vec_id = CASE WHEN p.frame_no % 2 = 0 THEN p.person % n ELSE p.frame_no % n END)"""


@query("SELECT session_id, frame_no, CASE WHEN reference IS NULL OR s >= 0.40 THEN 'completed' ELSE 'failed' END AS status, 1::BIGINT AS passed, reference IS NOT NULL AS compared FROM v_done", f"{V.FRAMES}, {_FINISHED}")
def finished_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a stream meet their people's embeddings in the table of entities; a session of one challenge ends by the comparison. A third of the people are unknown."""
    base = shared_dir(spark)
    vectors = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    person = F.substring_index("session_id", "-", 1).cast("bigint")
    frames = V.frames(spark, d).withColumns({"person": person, "entity_ref": F.concat(F.lit("BT-"), person)})
    shown = F.when(F.col("frame_no") % 2 == 0, F.col("person") % n).otherwise(F.col("frame_no") % n)
    frames.withColumn("shown", shown).join(vectors, F.col("shown") == F.col("vec_id")).drop("shown", "vec_id", "person").write.parquet(f"{base}/frames")
    people = V.table(spark, d, "events").select(F.col("user_id").cast("bigint").alias("person")).distinct().where("person % 3 <> 0")
    people.join(vectors, F.col("person") % n == F.col("vec_id")).select(F.concat(F.lit("BT-"), "person").alias("entity_ref"), "embedding").write.parquet(f"{base}/entities")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/frames").schema).parquet(f"{base}/frames")
    joined = kyc.with_references(stream, spark.read.parquet(f"{base}/entities"))
    with flows.rocksdb(spark):
        found = flows.run_once(kyc.sessions(joined, ["turn_left"]), spark, f"{base}/sink", f"{base}/checkpoint")
    return found.where("status in ('completed', 'failed')").select("session_id", "frame_no", "status", F.col("passed").cast("bigint").alias("passed"), F.col("similarity").isNotNull().alias("compared"))


_SYNCED = """v_line AS (SELECT lang, doc_id, text || chr(10) AS line FROM documents WHERE text IS NOT NULL),
v_file AS (SELECT lang, count(*) FILTER (doc_id % 2 = 0) > 0 AS had, sha256(string_agg(line, '' ORDER BY doc_id)) AS digest, CAST(sum(strlen(line)) AS BIGINT) AS bytes,
  sha256(coalesce(string_agg(line, '' ORDER BY doc_id) FILTER (doc_id % 2 = 0), '')) AS old_digest, CAST(coalesce(sum(strlen(line)) FILTER (doc_id % 2 = 0), 0) AS BIGINT) AS old_bytes FROM v_line GROUP BY 1)"""


@query(
    """SELECT v AS version, lang || '.txt' AS name, CASE WHEN v = 0 OR lang = 'fr' THEN 'copied' WHEN lang = 'en' THEN 'updated' WHEN lang = 'es' THEN 'removed' ELSE 'skipped' END AS status,
  CASE WHEN v = 1 AND lang IN ('en', 'fr') THEN digest ELSE old_digest END AS sha256, CASE WHEN v = 1 AND lang IN ('en', 'fr') THEN bytes ELSE old_bytes END AS length,
  CASE WHEN v = 1 AND lang IN ('en', 'fr') THEN 1 ELSE 0 END::BIGINT AS held_by
FROM v_file, (SELECT unnest([0, 1])::BIGINT AS v) WHERE had AND NOT (v = 0 AND lang = 'fr')""",
    _SYNCED,
)
def synced_files(spark: SparkSession, d: str) -> DataFrame:
    """Two syncs of a file for each language. Between them one has changed, one is new, one has gone and one is as it was."""
    base = shared_dir(spark)
    docs = V.table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text")
    half = docs.where("doc_id % 2 = 0")
    out = None
    for version, (rows, langs) in enumerate(((half, ["de", "en", "es"]), (docs, ["en", "fr"]))):
        sync.write_lines(rows.where(F.col("lang").isin(langs)).select(F.concat("lang", F.lit(".txt")).alias("name"), "doc_id", F.col("text").alias("value")), f"{base}/source", "doc_id")
        if version:
            remove(spark, f"{base}/source/es.txt")
        done = sync.sync(spark, f"{base}/source", f"{base}/target", ["txt"])
        found = sync.manifest(spark, f"{base}/target", done.version).select(F.lit(version).cast("bigint").alias("version"), F.col("path").alias("name"), "status", "sha256", "length", "held_by")
        out = found if out is None else out.unionByName(found)
    return out
