"""Streams that are stopped and repeated, folders that are synced again, late records."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsleuth.operators import cases
from docsleuth.plans.arrivals import repeated_last_batch
from docsleuth.sources import sync
from docsleuth.sources.shared import remove
from docsleuth.streaming import activity, flows, kyc, lifecycle

DECIDED = ("cleared", "fraud_confirmed")


def plain_lifecycle(rows, state):
    """Assessment by assessment, as a desk would do it."""
    state, out = dict(state), []
    for case, level, at in sorted(rows, key=lambda r: r[2]):
        if case in state and state[case] in DECIDED:
            continue
        if level in ("high", "medium"):
            event = ("triage", "open", "high") if level == "high" else ("new", "open", "normal")
        elif case not in state:
            event = ("closed", "cleared", "normal")
        else:
            continue
        state[case] = event[1]
        out.append((case, *event, at))
    return Counter(out)


ROWS = [(f"c{i * i % 23}", ("low", "high", "LOW", "medium")[(i * 7 + i // 5) % 4].lower(), f"2024-{i:04d}") for i in range(160)]
STATE = {"c0": "cleared", "c1": "open", "c2": None, "c3": "fraud_confirmed", "c4": "escalated", "c99": "open"}


def test_lifecycle_in_order(spark):
    rows = spark.createDataFrame(ROWS, "case_key string, risk_level string, generated_at string")
    state = spark.createDataFrame(list(STATE.items()), "case_key string, disposition string")
    got = Counter(map(tuple, cases.lifecycle_in_order(rows, state, "generated_at").collect()))
    assert got == plain_lifecycle(ROWS, STATE)


@pytest.mark.parametrize("compact_every", [2, 20])
def test_each_batch_counts_once(spark, tmp_path, compact_every):
    state = spark.createDataFrame(list(STATE.items()), "case_key string, disposition string")
    sink = lifecycle.LifecycleSink(state, f"{tmp_path}/cases", compact_every=compact_every)
    kind = "case_key string, risk_level string, generated_at string"
    for k in range(0, 160, 40):
        spark.createDataFrame(ROWS[k : k + 40], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = lambda: spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        lifecycle.run_lifecycle(stream(), sink, f"{tmp_path}/checkpoint")
        if k == 40:  # failed after its ledger entry: the batch comes again and changes nothing
            before = sink.committed(spark)
            repeated_last_batch(spark, f"{tmp_path}/checkpoint")
            lifecycle.run_lifecycle(stream(), sink, f"{tmp_path}/checkpoint")
            assert sink.committed(spark) == before
        if k == 80:  # failed before it, with half of its events written: they are written anew
            last = max(sink.committed(spark))
            remove(spark, f"{tmp_path}/cases/ledger/{last}")
            sink.events(spark).limit(1).drop("batch_id").write.mode("append").parquet(f"{tmp_path}/cases/events/{last}")
            repeated_last_batch(spark, f"{tmp_path}/checkpoint")
            lifecycle.run_lifecycle(stream(), sink, f"{tmp_path}/checkpoint")
    assert len(sink.committed(spark)) == 4
    assert Counter(map(tuple, sink.events(spark).drop("batch_id").collect())) == plain_lifecycle(ROWS, STATE)


def test_sync_versions(spark, tmp_path):
    source, target = tmp_path / "in", f"{tmp_path}/out"
    (source / "deep").mkdir(parents=True)
    (source / "a.txt").write_bytes(b"one")
    (source / "deep" / "b.TXT").write_bytes(b"x")
    (source / "c.exe").write_bytes(b"no")
    assert sync.versions(spark, target) == [] and sync.manifest(spark, target).count() == 0
    first = sync.sync(spark, str(source), target, ["txt"])
    assert (first.version, first.counts) == (0, {"copied": 2})
    (source / "a.txt").write_bytes(b"another")
    (source / "d.txt").write_bytes(b"new" * 100_000)
    (source / "deep" / "b.TXT").unlink()
    # a sync that ended before its manifest
    (tmp_path / "out" / "snapshots" / "v000001" / "files").mkdir(parents=True)
    (tmp_path / "out" / "snapshots" / "v000001" / "files" / "a.txt.part").write_bytes(b"ano")
    assert sync.versions(spark, target) == [0]
    second = sync.sync(spark, str(source), target, ["txt"])
    assert (second.version, second.counts) == (1, {"updated": 1, "copied": 1, "removed": 1})
    third = sync.sync(spark, str(source), target, ["txt"])
    assert (third.version, third.counts) == (2, {"skipped": 2})
    stored = {r["path"]: open(r["stored"], "rb").read() for r in sync.stored(spark, target).collect()}
    assert stored == {"a.txt": b"another", "d.txt": b"new" * 100_000}
    assert {r["path"]: open(r["stored"], "rb").read() for r in sync.stored(spark, target, 0).collect()} == {"a.txt": b"one", "deep/b.TXT": b"x"}
    assert not (tmp_path / "out" / "snapshots" / "v000002" / "files").exists()


def test_late_and_repeated_records(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    arrivals = [[(1, "a", at(0)), (2, "a", at(4)), (2, "a", at(4)), (3, "a", at(30))], [(2, "a", at(4)), (4, "a", at(10)), (5, "a", at(31)), (3, "a", at(30)), (6, "a", at(59))]]
    kind = "id int, k string, ts string"
    for rows in arrivals:
        spark.createDataFrame(rows, kind).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id int, k string, ts timestamp").parquet(f"{tmp_path}/in")
        out = flows.run_once(activity.sessions(stream, ["k"], ["id"]), spark, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    # minute 10 comes after the watermark has passed 20; the session of minute 59 is still open
    assert sorted((r["start"].minute, r["end"].minute, r["n"]) for r in out.collect()) == [(0, 9, 2), (30, 36, 2)]


def test_one_reference_a_person(spark):
    people = spark.createDataFrame([("p", [1.0, 0.0]), ("p", [0.5, 1.0]), ("q", None)], "entity_ref string, embedding array<double>")
    frames = spark.createDataFrame([(1, "p"), (2, "q"), (3, None), (4, "r")], "frame_no int, entity_ref string").withColumn("reference", F.lit("old"))
    got = {r["frame_no"]: r["reference"] for r in kyc.with_references(frames, people).collect()}
    assert got == {1: [1.0, 0.0], 2: None, 3: None, 4: None}
