"""What the review of round 4 found."""

import numpy as np
from pyspark.sql import functions as F

from docsleuth.operators import extract, similar
from docsleuth.plans import catalogue, papers


def _below_exchanges(plan: str) -> list[str]:
    """The lines of a plan that stand below some exchange."""
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out, top = [], None
    for line in plan.splitlines():
        if top is not None and depth(line) > top:
            out.append(line)
        elif "Exchange" in line and "Broadcast" not in line:
            top = depth(line)
        else:
            top = None
    return out


def test_word_sets_are_compared_where_they_meet(spark, monkeypatch):
    """every pair that met was shuffled, then joined twice, so disk grew with the pairs. Same pairs when ids and keys are dealt over rows and tasks."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.choice(20, size, replace=False)) for size in rng.integers(1, 9, 90)] + ["w1 w2 w3 w4"] * 40 + ["", None]
    a = spark.createDataFrame(list(enumerate(texts[::2])), "i int, s string")
    b = spark.createDataFrame([(str(j), t) for j, t in enumerate(texts[1::2])], "j string, t string")
    words = [set((t or "").split()) for t in texts]
    want = sorted((i, str(j), len(x & y)) for i, x in enumerate(words[::2]) for j, y in enumerate(words[1::2]) if x and y and len(x & y) / len(x | y) >= 0.5)
    found = similar.set_join(a, b, "i", "j", "s", "t")
    assert not any("array_intersect" in line for line in _below_exchanges(found._jdf.queryExecution().executedPlan().toString()))
    assert sorted(tuple(r)[:3] for r in found.collect()) == want
    for name, most in (("MOST_IDS", 3), ("MOST_MET", 20)):
        monkeypatch.setattr(similar, name, most)
    assert sorted(tuple(r)[:3] for r in similar.set_join(a, b, "i", "j", "s", "t").collect()) == want


def test_name_matches_take_little_disk(spark, tmp_path, monkeypatch):
    """rows came a customer at a time, with all suppliers of the nation, which Parquet can't compress. All rows also from small cells and runs."""
    spark.range(600).selectExpr("id AS c_custkey", "id % 2 AS c_nationkey", "'MACHINERY' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20_000).selectExpr("id * 7 AS s_suppkey", "id % 2 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    catalogue.name_matches(spark, str(tmp_path)).write.parquet(f"{tmp_path}/found")
    assert spark.read.parquet(f"{tmp_path}/found").distinct().count() == 6_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 0.5 * 6_000_000
    for name, most in (("CELL", 7), ("RUN", 3)):
        monkeypatch.setattr(catalogue, name, most)
    small = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in catalogue.name_matches(spark, small).collect())
    nations = {r["s_suppkey"]: r["s_nationkey"] for r in spark.read.parquet(f"{small}/supplier.parquet").collect()}
    assert got == sorted((r["c_custkey"], k, 2) for r in spark.read.parquet(f"{small}/customer.parquet").collect() for k, n in nations.items() if r["c_nationkey"] == n)


def test_scans_build_no_signals(spark):
    """every signal with its details was built, and markers were searched below a lambda, which Spark interprets."""
    found = papers.scanned_payslips(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "details" not in plan and "array_max(array(" in plan and "contains(" in plan.lower()


def test_types_are_those_of_classify(spark):
    """types from plain columns: ties go to the first type, files' names count two, overlapping markers count each, nulls are empty."""
    texts = ["", None, "Invoice Number 7", "invoice receipt", "Net Pay and gross earnings\nBILL TO", "nothing", "payslip\r\n\r\nsalary slip\u2028x", "\n\n\n\n", "a\fInvoice\x85b"]
    rows = [(i * 10 + j, n, t) for i, t in enumerate(texts) for j, n in enumerate(["a.pdf", "Payslip_1.pdf", "receipt", None])]
    df = extract.pages_of_text(spark.createDataFrame(rows, "doc_id long, source_name string, text string"))
    full = F.array_join(F.transform("pages", lambda p: p["text"]), "\n")
    c = extract.classify(F.col("source_name"), full)
    want = df.select("doc_id", c["type"], c["confidence"]).collect()
    got = extract.summaries(df).select("doc_id", "doc_type", "type_confidence").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({t for _, t, _ in got}) > 3
    listed = {r["doc_id"]: r["line_list"] for r in extract.summaries(df).select("doc_id", "line_list").collect()}
    assert listed[60] == ["payslip", "salary slip", "x"] and listed[70] == [] and listed[80] == ["a", "Invoice", "b"]
