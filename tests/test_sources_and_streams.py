import datetime as dt
import json

import numpy as np

from pyspark.sql import functions as F

from docsleuth.plans import catalogue
from docsleuth.plans import views as V
from docsleuth.sources import files
from docsleuth.streaming import flows, kyc

SF = "/root/testdata/sf0.001"


def test_folder_and_manifest(spark, tmp_path):
    for n in ("one.pdf", "two.json", "skip.exe"):
        (tmp_path / n).write_text("{}")
    found = files.listing(spark, str(tmp_path), ["pdf", ".JSON"])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["one.pdf", "two.json"]
    (tmp_path / "m.json").write_text(json.dumps({"paths": [str(tmp_path / "one.pdf"), "/none.pdf"]}))
    assert files.manifest(spark, str(tmp_path / "m.json")).count() == 2
    assert files.manifest(spark, str(tmp_path / "m.json"), found).count() == 1
    (tmp_path / "m.csv").write_text("path,file\n,a.pdf\nb.pdf,\n")
    assert sorted(r["path"] for r in files.manifest(spark, str(tmp_path / "m.csv")).collect()) == ["a.pdf", "b.pdf"]
    assert files.unseen(found, found.limit(0)).count() == 2 and files.unseen(found, found).count() == 0
    assert files.prefix_uri("fraud-inputs", "payroll/jan", "s3") == "s3://fraud-inputs/payroll/jan"


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 /Type /Sig /ByteRange")
    row = files.fingerprints(spark, str(tmp_path)).first()
    assert row["signature_markers"] == ["/Type/Sig", "/ByteRange"] and row["pdf_version"] == "1.7" and len(row["sha256"]) == 64


def test_logs(spark, tmp_path):
    (tmp_path / "l.log").write_text('{"ts":"2026-01-01T00:00:00Z","level":"INFO","msg":"m","elapsed_ms":3.5}\nnot json\n')
    rows = {r["level"]: r for r in files.logs(spark, str(tmp_path / "l.log")).collect()}
    assert set(rows) == {"INFO", "RAW"} and rows["RAW"]["msg"] == "not json" and rows["INFO"]["elapsed_ms"] == 3.5


def test_tables(spark, tmp_path):
    notes = spark.sql("SELECT 'c' AS case_key, 'n' AS note, 'me' AS author, timestamp'2026-01-01' AS created_at")
    files.write_table(notes, str(tmp_path), "case_notes")
    rows, n = files.preview(spark, str(tmp_path), "case_notes", 5)
    assert rows.count() == 1 and n.first()["n"] == 1


def frame(**x):
    return {"nose_rel_x": 0.5, "pitch": 0.6, "ear": 0.3, "det_score": 1.0} | x


def test_challenges():
    first = lambda kind, frames: next((i for i in range(1, len(frames) + 1) if kyc.challenge_passed(kind, frames[:i])), None)
    assert first("turn_left", [frame(nose_rel_x=x) for x in (0.5, 0.55, 0.63)]) == 3
    assert first("turn_left", [frame(nose_rel_x=x) for x in (0.63, 0.5)]) is None
    assert first("turn_right", [frame(nose_rel_x=x) for x in (0.5, 0.45, 0.38)]) == 3
    assert first("nod", [frame(pitch=x) for x in (0.6, 0.62, 0.7, 0.8, 0.88, 0.9)]) == 6
    assert first("blink", [frame(ear=x) for x in [0.3] * 8 + [0.05] * 4 + [0.3] * 5]) == 9
    assert first("blink", [frame() for _ in range(17)]) is None
    assert first("blink", [frame(det_score=x) for x in [0.98] * 8 + [0.9] + [0.97] * 3]) == 9


def test_session_stream_equals_plain_loop(spark):
    got = sorted((r["session_id"], r["frame_no"], r["challenge"]) for r in catalogue.liveness_sessions(spark, SF).collect() if r["status"] != "expired")
    want, kinds = [], kyc.CHALLENGES
    sessions = {}
    for r in V.frames(spark, SF).orderBy("frame_no").collect():
        sessions.setdefault(r["session_id"], []).append(r.asDict())
    for key, frames in sessions.items():
        n, history = 0, []
        for f in frames:
            if n == len(kinds):
                break
            history.append(f)
            if kyc.challenge_passed(kinds[n], history):
                want.append((key, f["frame_no"], kinds[n]))
                n, history = n + 1, []
    assert got == sorted(want)


def test_long_challenges_keep_few_frames(spark):
    """Folding the frames between the first and the recent ones changes no verdict."""
    rng = np.random.default_rng(2)
    for kind in kyc.CHALLENGES:
        for _ in range(40):
            whole, kept, gone, low = [], [], 0, [np.inf, np.inf]
            for _ in range(90):
                whole.append(frame(nose_rel_x=rng.uniform(0.35, 0.65), pitch=rng.uniform(0, 0.3), ear=rng.uniform(0.1, 0.3), det_score=rng.uniform(0.8, 1)))
                kept.append(whole[-1])
                assert kyc.challenge_passed(kind, whole) == kyc.challenge_passed(kind, kept, gone, tuple(low))
                if len(kept) > kyc.FIRST + kyc.RECENT:
                    old = kept.pop(kyc.FIRST)
                    gone, low = gone + 1, [min(low[0], old["ear"]), min(low[1], old["det_score"])]


def test_sessions_compare_with_the_reference(spark, tmp_path):
    rows = []
    for session, own, reference in (("same", [1.0, 0.0], [1.0, 0.0]), ("other", [0.0, 1.0], [1.0, 0.0]), ("none", [1.0, 0.0], None), ("lost", None, [1.0, 0.0])):
        rows += [(session, i, 0.7, 0.6, 0.3, 1.0, dt.datetime(2024, 1, 1, 0, 0, i), own, reference) for i in range(4)]
    rows += [("idle", 0, 0.5, 0.6, 0.3, 1.0, dt.datetime(2024, 1, 1), None, None), ("late", 0, 0.5, 0.6, 0.3, 1.0, dt.datetime(2024, 1, 1, 2), None, None)]
    schema = "session_id string, frame_no bigint, nose_rel_x double, pitch double, ear double, det_score double, ts timestamp, embedding array<double>, reference array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "f"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = flows.run_once(kyc.sessions(stream, ["turn_left"]), spark, str(tmp_path / "s"), str(tmp_path / "c")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {r["session_id"]: (r["status"], r["similarity"]) for r in found} == {"same": ("completed", 1.0), "other": ("failed", 0.0), "none": ("completed", None), "lost": ("failed", 0.0), "idle": ("expired", None)}


def test_entry_point_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_round_trip_query_pushes_filters(spark):
    plan = V.ledger(spark, SF).where(F.col("debit") > 0)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "Python" not in plan
