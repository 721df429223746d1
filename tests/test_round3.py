"""Findings of round 3."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from docsleuth.operators import dots, extract, identity, similar
from docsleuth.plans import papers


def test_summaries_need_no_join(spark):
    """labels of all documents were broadcast through the driver."""
    rows = extract.pages_of_text(spark.createDataFrame([(1, "a", "Net Pay   5\nNet Pay   7   Odd   5\nNet Pay   5"), (2, "b", "one")], "doc_id long, source_name string, text string"))
    found = extract.summaries(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {r["doc_id"]: (r["named_fields"], r["value_count"]) for r in found.select("doc_id", "named_fields", "value_count").collect()}
    assert got == {1: ({"net_pay": ["5", "7"], "odd": ["5"]}, 3), 2: ({}, None)}
    table = extract.named_fields(extract.pairs(extract.lines(rows))).collect()
    assert [(r["doc_id"], r["named_fields"], r["value_count"]) for r in table] == [(1, *got[1])]


def test_statement_sides_after_a_misprinted_balance(spark, tmp_path):
    """F8: a credit of 50,000 after a balance misprinted by 100,000 looks like a debit by the change of balance."""
    at = dt.datetime(2024, 1, 1)
    rows = [(97, at, 7, "click", 1.0, '{"k": 1}'), (98, at + dt.timedelta(1), 7, "signup", 5.0, '{"k": 2}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = papers.extracted_statements(spark, str(tmp_path)).select("n_rows", "debits", "credits").collect()
    assert [tuple(r) for r in found] == [(2, 0, 50_000)]


def test_name_matches_cut_words_for_texts_only(spark):
    """words were cut and intersected for every pair of rows of a nation, in as many tasks as the customers' file had row groups."""
    from docsleuth.plans import catalogue

    found = catalogue.name_matches(spark, "/root/testdata/sf0.001")
    steps = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    rows = [s for s in steps if "array_intersect" in s and "c_custkey" in s]
    assert not rows and any("RepartitionByExpression [c_custkey" in s for s in steps)


def test_key_points_are_not_broadcast(spark):
    """tables of all key points were broadcast through the driver."""
    from docsleuth.plans import desk

    plan = desk.copy_moves(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_label_pairs_read_their_texts_once(spark):
    """F16: identifiers and amounts were joined to the pairs that they come from."""
    plan = papers.label_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("HashJoin", "MergeJoin", "Exchange"))


def test_sessions_share_keys_of_state(spark, tmp_path):
    """each session was a key with its own state, timer and data frames. Two arrivals, all sessions in few buckets; embeddings don't reach the keyed state."""
    from docsleuth.streaming import flows, kyc

    at = lambda minute, second=0: dt.datetime(2024, 1, 1, minute // 60, minute % 60, second)
    kind = "session_id string, frame_no bigint, nose_rel_x double, pitch double, ear double, det_score double, ts timestamp, embedding array<float>, reference array<float>"
    turned = [(f"s{i}", k, 0.5 if k < 3 else 0.7, 0.6, 0.3, 1.0, at(0, k), [0.6, 0.8], [1.0, 0.0] if i % 2 else None) for i in range(20) for k in range(2 + i % 3)]
    # s2, s5, ... have passed in the first arrival; a later frame makes the others pass, but for those of i % 3 == 0, which go on to expire
    again = [(f"s{i}", 9, 0.7, 0.6, 0.3, 1.0, at(1), None, [1.0, 0.0] if i % 2 else None) for i in range(20) if i % 3]
    later = [("z", 0, 0.5, 0.6, 0.3, 1.0, at(100), None, None)]
    before, kyc.BUCKETS = kyc.BUCKETS, 3
    try:
        for rows in (turned, again, later):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
            found = kyc.sessions(spark.readStream.schema(kind).parquet(f"{tmp_path}/f"), ["turn_left"])
            with flows.rocksdb(spark):
                out = flows.run_once(found, spark, f"{tmp_path}/s", f"{tmp_path}/c")
    finally:
        kyc.BUCKETS = before
    got = sorted((r["session_id"], r["frame_no"], r["status"]) for r in out.collect())
    want = []
    for i in range(20):
        if i % 3 == 0:
            want.append((f"s{i}", -1, "expired"))
        elif i % 3 == 1:
            want.append((f"s{i}", 9, "failed" if i % 2 else "completed"))  # the last frame has no embedding of its own
        else:
            want.append((f"s{i}", 3, "completed"))
    assert got == sorted(want)


def test_vectors_meet_in_blocks(spark):
    """all pairs of a label met in one task, product by product. Same pairs by blocks of any size, with nulls and copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[40], x[41] = x[10], x[11]
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)] + [(200, None, 0), (201, [1.0, None], 0), (202, [1.0], 1), (203, [0.5], 1), (204, [9.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted([(i % 2, i, j) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and x[i] @ x[j] >= 0.4] + [(1, 202, 203)])
    vectors_of = df.select(F.col("label").alias("block"), F.col("vec_id").alias("a"), F.col("embedding").alias("v"))
    for block in (7, 4096):
        assert sorted(tuple(r)[:3] for r in dots.matches(vectors_of, None, "block", 0.4, block).collect()) == want
    assert sorted(tuple(r)[:3] for r in identity.embedding_links(df).collect()) == want
    every = sorted((i, j) for i in range(0, 90, 10) for j in range(90) if i != j and x[i] @ x[j] >= 0.4)
    assert sorted(tuple(r)[:2] for r in identity.embedding_search(df, F.col("vec_id").between(0, 89) & (F.col("vec_id") % 10 == 0), block=7).collect()) == every
    plan = identity.embedding_links(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan


def test_word_sets_meet_by_two_words(spark, monkeypatch):
    """sets met by single words, so what met grew with the square of a word's frequency. Same pairs with few words, with many, and by one word only."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in rng.choice(30, size, replace=False)) for size in rng.integers(1, 12, 160)] + ["", None, "w1", "w1 w2"]
    a = spark.createDataFrame(list(enumerate(texts[::2])), "i int, s string")
    b = spark.createDataFrame(list(enumerate(texts[1::2])), "j int, t string")
    words = [set((t or "").split()) for t in texts]
    for most in (64, 5, 0):
        monkeypatch.setattr(similar, "MOST_PAIRED", most)
        for least in (0.3, 0.5):
            want = {(i, j) for i, x in enumerate(words[::2]) for j, y in enumerate(words[1::2]) if x and y and len(x & y) / len(x | y) >= least}
            assert {(r["i"], r["j"]) for r in similar.set_join(a, b, "i", "j", "s", "t", least).collect()} == want
