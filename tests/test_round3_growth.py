"""Findings of round 3 on growth: per-row work is spread over tasks, and done once."""

from __future__ import annotations

from collections import Counter

from docsleuth.plans import filings

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_signals_compute_their_own_fields_only(spark):
    """fields, numbers and the ledger of all packs were computed for every row, in as many tasks as the orders' file had row groups."""
    for found in (filings.compliance_signals, filings.insurance_signals, filings.error_profiles):
        plan = plan_of(found(spark, SMALL))
        assert "RepartitionByExpression" in plan and "__ledger" not in plan and "__text tan" not in plan


def test_files_of_rows_are_written_in_tasks(spark, tmp_path):
    """one task wrote all files and the driver renamed each. A second run replaces what a first one left."""
    from docsleuth.sources import files, sync

    rows = spark.range(50).selectExpr("concat(id, '.json') AS name", """concat('{"pages":[{"page":1,"text":"é ', id, '"}]}') AS value""").repartition(7)
    for _ in range(2):
        sync.write_each(rows, f"{tmp_path}/raw")
    assert sorted(p.name for p in (tmp_path / "raw").iterdir()) == sorted(f"{i}.json" for i in range(50))
    found = files.raw_documents(spark, f"{tmp_path}/raw").selectExpr("source_name", "pages[0].text AS text").collect()
    assert sorted((r["source_name"], r["text"]) for r in found) == sorted((f"{i}.json", f"é {i}") for i in range(50))


def test_papers_are_spread(spark):
    """texts were made and read in as many tasks as the orders' file had row groups."""
    from docsleuth.plans import papers

    for found in (papers.extracted_letters, papers.named_values):
        assert "RepartitionByExpression [k" in plan_of(found(spark, SMALL))


def test_markers_are_plain_text(spark):
    """markers are looked for as quoted patterns."""
    from pyspark.sql import functions as F

    from docsleuth.operators import extract

    c = extract.classify(F.lit("x"), F.col("t"), [("a", ["a.c", "q\\e*", ""]), ("generic", [])])
    got = [r["m"] for r in spark.createDataFrame([("abc",), ("A.C q\\E*",)], "t string").select(c["markers"]["a"].alias("m")).collect()]
    assert got == [[""], ["a.c", "q\\e*", ""]]


def test_streamed_scores_build_no_signals(spark):
    """a stream of scores built every signal, message and detail."""
    from docsleuth.plans import views
    from docsleuth.streaming import flows

    slips = views.slips(spark, SMALL)
    lean, whole = flows.score_stream(slips, types=["payslip"], with_signals=False), flows.score_stream(slips, types=["payslip"])
    assert "signals" in whole.columns and "signals" not in lean.columns


def test_files_of_lines_are_written_in_pieces(spark, tmp_path):
    """a file of many rows was gathered, and copied, by one task."""
    from docsleuth.sources import sync

    rows = spark.range(1000).selectExpr("concat('n', id % 3, '.txt') AS name", "999 - id AS at", "concat('é', repeat('x', int(id % 50)), id) AS value").repartition(5)
    made = {f"n{k}.txt": "".join(f"é{'x' * (i % 50)}{i}\n" for i in reversed(range(1000)) if i % 3 == k) for k in range(3)}
    for folder, in_place in (("a", None), ("b", False), ("a", None)):
        sync.write_lines(rows, f"{tmp_path}/{folder}", "at", piece=2000, in_place=in_place)
        assert {p.name: p.read_text() for p in (tmp_path / folder).iterdir()} == made
    sync.write_lines(rows.where("at > 990"), f"{tmp_path}/a", "at", piece=2000)
    assert (tmp_path / "a" / "n0.txt").read_text() == "éxxxxxx6\néxxx3\né0\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_large_files_are_copied_by_tasks_of_their_own(spark, tmp_path, monkeypatch):
    """up to 200 files came to one task, however large they were."""
    from docsleuth.sources import sync

    monkeypatch.setattr(sync, "LARGE", 1000)
    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / "in" / f"{i}.txt").write_bytes(b"x" * (1000 + i if i < 6 else i))
    done = sync.sync(spark, f"{tmp_path}/in", f"{tmp_path}/out", ["txt"])
    assert done.counts == {"copied": 12}
    tasks = Counter(r["f"] for r in sync.manifest(spark, f"{tmp_path}/out").selectExpr("input_file_name() AS f").collect())
    assert sorted(tasks.values()) == [1] * 6 + [6]
    assert {r["path"]: len(open(r["stored"], "rb").read()) for r in sync.stored(spark, f"{tmp_path}/out").collect()} == {f"{i}.txt": 1000 + i if i < 6 else i for i in range(12)}


def test_failures_are_compiled(spark):
    """rules were built with details below a lambda, which Spark interprets, and fields in code too long for the JVM to compile (8,000 bytes)."""
    from docsleuth.operators import rules
    from docsleuth.plans import views

    code = filings.failed_rules(spark, SMALL)._jdf.queryExecution().debug().codegenToSeq()
    assert all(code.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(code.size()))
    slips = views.slips(spark, SMALL)
    lean = rules.failed(slips, rules.domain_failures(types=["payslip"])).selectExpr("person", "period", "concat('domain::', signal.name) AS name", "signal.severity", "signal.score")
    whole = rules.failed_signals(rules.assess(slips, types=["payslip"])).where("signal.name like 'domain::%'").select("person", "period", "signal.name", "signal.severity", "signal.score")
    got = Counter(map(tuple, lean.collect()))
    assert got == Counter(map(tuple, whole.collect())) and len(got) > 100


def test_fields_by_several_keys(spark):
    """the first key with a value counts, for texts and numbers; an empty value is none."""
    from docsleuth.operators import rules

    text, number, one = rules.text("k1", "k2"), rules.num("k1", "k2"), rules.num("k1")
    rows = [({"k1": "", "k2": "7"},), ({"k2": "Rs 8"},), ({"k1": "9", "k2": "1"},), ({"k1": "x", "k2": "1"},), ({"k1": ""},), ({},), ({"k1": None, "k2": "3"},)]
    got = rules.with_fields(spark.createDataFrame(rows, "key_fields map<string,string>")).select(text, number, one).collect()
    assert [tuple(r) for r in got] == [("7", 7, None), ("Rs 8", 8, None), ("9", 9, 9), ("x", None, None), (None, None, None), (None, None, None), ("3", 3, None)]


def test_repeated_values_of_a_ledger(spark):
    """each use of a reference or a salary month was looked up among all before it, which were read again for it."""
    from pyspark.sql import functions as F

    from docsleuth.operators import ledger

    rows = [("01-01-2024", "Salary", " a "), ("02-01-2024", "x", "b"), ("03-01-2024", "salary", "a"), ("31-02-x", "salary", ""), ("05-02-2024", "salary", None), ("06-01-2024", "SAL CR", "b"), ("07-01-2024", "x", "a"), ("?", "salary", "c")]
    made = [(1, [(*r, 0, 0, 0) for r in rows]), (2, []), (3, None)]
    t = F.col("t")
    found = spark.createDataFrame(made, f"k int, t {ledger.TRANSACTIONS}").select("k", ledger.repeated_reference_array(t).alias("refs"), ledger.repeated_salary_array(t).alias("months"))
    assert {r["k"]: (r["refs"], r["months"]) for r in found.collect()} == {1: (["a", "b", "a"], ["2024-01", "2024-01"]), 2: ([], []), 3: (None, None)}


def test_statements_are_made_and_cut_once(spark):
    """ledgers were gathered twice and joined, and each line was cut into columns twice."""
    from docsleuth.plans import papers

    plan = plan_of(papers.scanned_statements(spark, SMALL))
    assert "Join" not in plan and plan.count("Relation [") == 1 and plan.count(r"\s{2,}") == 1
