"""Joins that prune against all pairs, order statistics against sorted values, ranges against whole rows and files."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsleuth.operators import extract, ledger, quantiles, rules, segments, similar, vectors
from docsleuth.sources import ranges


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0, 0.34])
def test_set_join(spark, least):
    rnd = random.Random(int(least * 100))
    words = [f"w{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(4000)]
    texts = [" ".join(rnd.sample(words, rnd.randrange(9))) for _ in range(150)] + [None, "", "  ", "one", "ONE one", "a b c d", "d c b a"] + ["the same words"] * 20
    rows = list(enumerate(texts))
    a, b = spark.createDataFrame(rows, "i int, s string"), spark.createDataFrame([(j + 1000, s) for j, s in rows], "j int, t string")
    sets = [set((s or "").lower().split()) for s in texts]
    want = {(i, j + 1000): len(x & y) for i, x in enumerate(sets) for j, y in enumerate(sets) if x and y and len(x & y) / len(x | y) >= least}
    got = similar.set_join(a, b, "i", "j", "s", "t", least).collect()
    assert {(r["i"], r["j"]): r["shared"] for r in got} == want and len(got) == len(want)
    assert similar.set_join(a.limit(0), b, "i", "j", "s", "t").count() == 0


@pytest.mark.parametrize(("radius", "most_rows"), [(3, 512), (3, 4), (1, 6), (0, 3)])
def test_near_hashes(spark, radius, most_rows):
    rnd = random.Random(radius)
    values = {rnd.getrandbits(20) for _ in range(60)} | {rnd.getrandbits(64) for _ in range(20)}
    for v in list(values):
        for _ in range(3):
            values.add(v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 5))))
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values + values[:5])] + [(9999, None)], "i int, h long")
    ones = lambda x: bin(x & ((1 << 64) - 1)).count("1")
    want = {tuple(sorted((x, y))) for k, x in enumerate(values) for y in values[k + 1 :] if ones(x ^ y) <= radius}
    got = [tuple(r) for r in similar.near_hashes(df, "h", radius, most_rows).collect()]
    assert set(got) == want and len(got) == len(want)
    near = {tuple(r) for r in similar.near_templates(df, "i", "h", radius, most_rows).collect()}
    least = {v: i for i, v in reversed(list(enumerate(values)))}
    assert near == {tuple(sorted((least[x], least[y]))) for x, y in want}
    members = {r["i"]: r["representative"] for r in similar.representatives(df, "i", "h").collect()}
    assert members[9999] == 9999 and members[len(values)] == 0 and len(members) == len(values) + 6


def test_masks_leave_a_block_clean():
    rnd = random.Random(4)
    for found in similar.masks(3, 6):
        for _ in range(200):
            bad = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any(not m & bad for m, _ in found)


def test_nearest(spark):
    rnd = random.Random(6)
    points = []
    for image in range(6):
        base = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(6)]
        for k in range(25):
            a, b = rnd.choice(base) if k % 5 else (rnd.getrandbits(63), rnd.getrandbits(63))
            for bit in rnd.sample(range(60), rnd.randrange(12)):
                a ^= 1 << bit
            points.append((image, k, [a, b]))
    df = spark.createDataFrame(points, "image int, k int, d array<long>")
    got = defaultdict(list)
    for r in similar.nearest(df, "image", "k", "d", 3, 40).collect():
        got[r["image"], r["a"]].append((r["distance"], r["b"]))
    ones = lambda x, y: sum(bin(p ^ q).count("1") for p, q in zip(x, y, strict=True))
    for image, k, d in points:
        want = sorted((ones(d, e), j) for i, j, e in points if i == image)[:3]
        assert sorted(got[image, k])[:3] == [x for x in want if x[0] <= 40] or len([x for x in want if x[0] <= 40]) > 3
    assert len(set((r["image"], r["a"], r["b"]) for r in similar.nearest(df, "image", "k", "d", 3, 40).collect())) == similar.nearest(df, "image", "k", "d", 3, 40).count()


def test_most_pairs_are_never_compared(spark):
    """Points that have close neighbours meet by blocks; fewer than half of the pairs of an image come together."""
    rnd = random.Random(9)
    rows = []
    for g in range(40):
        a, b = rnd.getrandbits(63), rnd.getrandbits(63)
        rows += [(0, 3 * g + j, [a ^ (1 << rnd.randrange(60)), b]) for j in range(3)]
    df = spark.createDataFrame(rows, "image int, k int, d array<long>")
    block = lambda name: df.select("image", F.col("k").alias(name), F.posexplode(similar._blocks(F.col("d"), 2)).alias("at", "v"))
    met = block("a").join(block("b"), ["image", "at", "v"]).select("a", "b").distinct().count()
    assert met < len(rows) ** 2 / 2
    assert similar.nearest(df, "image", "k", "d", 3, 40).count() == 9 * 40


@pytest.mark.parametrize(("accuracy", "around"), [(1000, 0.95), (10, 0.5), (2, 0.0)])
def test_order_statistics(spark, accuracy, around):
    rnd = random.Random(3)
    groups = {"big": [rnd.randrange(500) for _ in range(3000)], "ties": [7] * 50 + [8], "one": [3], "neg": [-5, -1, -9, -1], None: [4, 2]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("big", None)], "g string, v long")
    got = {r["g"]: r for r in quantiles.top(df, ["g"], "v", lambda n: F.greatest(F.lit(1), F.floor(n * 0.05)), around, accuracy).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        n = max(1, math.floor(len(vs) * 0.05))
        best = sorted(vs, reverse=True)[:n]
        assert (got[k]["n"], got[k]["k"], got[k]["kth"], got[k]["top_sum"]) == (len(vs), n, best[-1], sum(best))
    for q in (0.5, 0.95, 1.0):
        found = {r["g"]: r["value"] for r in quantiles.quantile(df, ["g"], "v", q, accuracy).collect()}
        assert found == {k: sorted(vs)[max(1, math.ceil(q * len(vs))) - 1] for k, vs in groups.items()}


@pytest.mark.parametrize("n", [1, 3, 16])
def test_rows_before_in_ranges(spark, n):
    """One account holds most rows, another none but one; days may be null and equal."""
    rnd = random.Random(5)
    rows = [("hot" if k % 10 else f"a{k % 7}", rnd.choice([None, *range(40)]), k, rnd.randrange(1000)) for k in range(600)] + [(None, 1, 1000, 5), (None, 2, 1001, 6), ("single", 1, 1002, 7)]
    df = spark.createDataFrame(rows, "account string, day int, no int, balance long").repartition(5)
    want, last = {}, {}
    for account, day, no, balance in sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2])):
        want[no] = last.get(account)
        last[account] = balance
    got = {r["no"]: r["previous"] and r["previous"]["balance"] for r in segments.with_previous(df, "account", ["day", "no"], ["balance"], n).collect()}
    assert got == want


def test_balance_errors_in_ranges(spark):
    rows = [("x", k // 3, k, 100 * (k % 2), 50, 10_000 + 25 * k + (20_000 if k == 40 else 0)) for k in range(90)]
    df = spark.createDataFrame(rows, "account string, txn_date int, txn_no int, credit long, debit long, balance long")
    assert Counter(map(str, ledger.balance_errors_in_ranges(df, ranges=8).select("txn_no", "diff", "round_number").collect())) == Counter(map(str, ledger.balance_errors(df).select("txn_no", "diff", "round_number").collect()))


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_files_by_ranges(spark, tmp_path, size):
    files = {"a.pdf": b"%PDF-1.4 x" * 9 + b"/Type" + b" \n" * 60 + b"/Sig", "b.bin": b"", "c.bin": b"/ByteRang/ByteRange" * 3, "d.bin": b"/Type /Sog /FT x /Sig /Contents", "e.bin": b"/FT" + b" " * 40 + b"/Si"}
    (tmp_path / "deep").mkdir()
    for name, body in files.items():
        (tmp_path / ("deep" if name == "c.bin" else "") / name).write_bytes(body)
    got = {r["path"].rpartition("/")[2]: r for r in ranges.fingerprints(spark, f"file://{tmp_path}", size).collect()}
    marks = {"a.pdf": ["/Type/Sig"], "b.bin": [], "c.bin": ["/ByteRange"], "d.bin": ["/Contents"], "e.bin": []}
    for name, body in files.items():
        r = got[name]
        assert (r["size_bytes"], r["sha256"], r["pdf_version"], r["signature_markers"]) == (len(body), hashlib.sha256(body).hexdigest(), "1.4" if name == "a.pdf" else None, marks[name])


def test_vector_index(spark):
    """Clustered unit vectors: the measured number of cells finds nine tenths of all matches in a few cells, all cells find all."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    x = base[rng.integers(0, 40, 1500)] + 0.6 * rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9999, None)], "vec_id long, embedding array<double>")
    index = vectors.build(df)
    assert index.rows.count() == 1500 and len(index.centres) == 1500 // vectors.CELL_ROWS
    near = x @ x.T
    want = {(i, j) for i in range(0, 1500, 10) for j in range(1500) if i != j and near[i, j] >= 0.40}
    queries = index.rows.where("id % 10 = 0").select("id", "vector")
    assert {tuple(r)[:2] for r in vectors.search(index, queries).collect()} == want
    probes, measured = vectors.enough_probes(index)
    got = {tuple(r)[:2] for r in vectors.search(index, queries, probes).collect()}
    assert got <= want and len(got) >= 0.85 * len(want) and measured >= 0.9 and probes < len(index.centres) / 2
    again = vectors.build(df)
    assert np.array_equal(again.centres, index.centres)
    none = vectors.build(df.limit(0))
    assert vectors.search(none, queries.limit(0)).count() == 0


def test_findings_of_tables_and_arrays(spark):
    """The table form of what rules ask of a ledger says the same as the array form, statement by statement."""
    rnd = random.Random(11)
    rows = []
    for account in range(12):
        balance = 500_000
        for no in range(rnd.randrange(1, 25)):
            debit, credit = rnd.choice([(0, 120_000), (120_500, 0), (300, 0), (0, 0), (0, 45_000)])
            balance += credit - debit + rnd.choice([0, 0, 0, 0, 10_000, 777])
            rows.append((account, f"2024-{1 + no // 9:02d}-{1 + no % 3:02d}", no, "Salary credit" if credit == 45_000 else "x", rnd.choice(["", " ", f"R{no % 7}", f"Q{no}"]), debit, credit, balance))
    df = spark.createDataFrame(rows, "account int, day string, txn_no int, desc string, ref string, debit long, credit long, balance long").withColumn("txn_date", F.col("day").cast("date"))
    table = {r["account"]: r["ledger_findings"].asDict() for r in ledger.findings(df, ranges=5).collect()}
    one = F.struct("txn_date", "txn_no", F.date_format("txn_date", "dd-MM-yyyy").alias("date"), "desc", "ref", "debit", "credit", "balance")
    arrays = df.groupBy("account").agg(F.array_sort(F.collect_list(one)).alias("t"))
    arrays = arrays.withColumn("t", F.transform("t", lambda x: F.struct(*[x[c].alias(c) for c in ("date", "desc", "ref", "debit", "credit", "balance")])).cast(ledger.TRANSACTIONS))
    for r in arrays.select("account", ledger.findings_of(F.col("t")).alias("f")).collect():
        for c in ("n_rows", "has_references", "has_salary", "pairs", "repeated_references", "repeated_months", "error_diff"):
            assert table[r["account"]][c] == r["f"][c], (r["account"], c)
    assert ledger.findings(df.limit(0)).count() == 0


def test_scores_without_signals(spark):
    """Risk summed straight from the rules is that of the signals."""
    texts = [(1, "letter", "TO WHOMSOEVER IT MAY CONCERN\nCIN: N/A\nwith effect from 01 January 2020\nCTC of Rs 12,00,000 per annum"), (2, "Payslip_1.pdf", "Payslip for the month of May 2024\nGross Earnings   100\nNet Pay   900   Basic   5\nHouse Rent Allowance   50"), (3, "other", "nothing")]
    rows = extract.pages_of_text(spark.createDataFrame([(i, n, t.replace("\\\n", "\n")) for i, n, t in texts], "doc_id int, source_name string, text string"))
    found = extract.summaries(rows).withColumns({"metadata": F.create_map().cast("map<string,string>"), "signature_markers": F.array().cast("array<string>")})
    day = F.lit("2024-06-01").cast("date")
    whole = {r["doc_id"]: (r["risk_score"], r["truth_score"], r["risk_level"], r["verdict"]) for r in rules.assess(found, day).collect()}
    bare = {r["doc_id"]: (r["risk_score"], r["truth_score"], r["risk_level"], r["verdict"]) for r in rules.assess(found, day, with_signals=False).collect()}
    assert whole == bare and len({v[0] for v in whole.values()}) == 3
