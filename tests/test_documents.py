import datetime

import pytest
from pyspark.sql import functions as F

from docsleuth.functions import fixed
from docsleuth.operators import cases, clusters, entities, extract, identity, ledger, reconcile, reports, rules, series

SLIP = """NeoZoom Technologies Pvt Ltd
Payslip for the month of January 2026
Employee ID   NZ66                   Employee Name     Asha Rao
Designation   Sr. Java Developer     Date of Joining   9/25/2023
Pay Date      2/3/2026               Paid Days         31
LOP Days      0                      UAN               100165351971
Basic                                             53500   EPF Contribution     6420
House Rent Allowance                              26750   Income Tax          70010
Fixed Bonus                                       32100   Professional Tax      200
Other Allowances                                 237362   Other Deductions        0
Gross Earnings                                   349712
Net Pay                                          273082   Total Deductions    76630
Rupees Two Hundred Seventy Three Thousand Eighty Two Only"""
BANK = """HDFC BANK
Statement period 01-Jan-2026 to 31-Jan-2026
Opening Balance   500000
01-01-2026  NEFT SALARY CREDIT  NEFT001  80000  580000
15-01-2026  NEFT/SELF TRANSFER IN  ST100002  500000  650000
Closing Balance   650000   IFSC Code   HDFC0001234"""


def summary(spark, name, text, **options):
    df = extract.pages_of_text(spark.createDataFrame([(1, name, text)], "doc_id long, source_name string, text string"))
    return extract.summaries(df, **options)


def test_payslip_text(spark):
    made = summary(spark, "Payslip_2026_Jan.pdf", SLIP)
    row = made.first()
    k = row["key_fields"]
    assert row["doc_type"] == "payslip" and row["issuer"].startswith("NeoZoom") and row["title"].startswith("Payslip for")
    assert (k["employee_id"], k["net_pay"], k["pay_period"], k["gross_earnings"]) == ("NZ66", "273082", "January 2026", "349712")
    assert row["dates"] == ["9/25/2023", "2/3/2026"]
    scored = made.withColumn("metadata", F.create_map().cast("map<string,string>")).withColumn("signature_markers", F.array().cast("array<string>"))
    out = rules.assess(scored).first()
    failed = {s["name"]: s["score"] for s in out["signals"] if not s["passed"] and s["score"]}
    assert failed == {"domain::basic_gross_proportion": 20, "domain::basic_minimum_proportion": 20}
    assert (out["risk_score"], out["truth_score"], out["risk_level"]) == (40, 60, "medium")
    money = extract.monetary(extract.pairs(extract.lines(extract.pages_of_text(spark.createDataFrame([(1, SLIP)], "doc_id long, text string")))))
    labels = {r["label"] for r in money.collect()}
    assert "Pay Date" not in labels and "Net Pay" in labels


def test_bank_text(spark):
    row = summary(spark, "bank statement.pdf", BANK).first()
    assert row["doc_type"] == "bank_statement" and row["key_fields"]["bank_name"] == "HDFC BANK" and row["key_fields"]["ifsc"] == "HDFC0001234"
    assert [(t["debit"], t["credit"], t["balance"]) for t in row["transactions"]] == [(0, 80000, 580000), (500000, 0, 650000)]
    assert (row["key_fields"]["period_from"], row["key_fields"]["period_to"]) == ("01-Jan-2026", "31-Jan-2026")


def test_classification(spark):
    for name, text, want in [
        ("employment_letter.pdf", "To Whomsoever It May Concern CIN Date of Joining HR Department", "employment_letter"),
        ("form16.pdf", "FORM 16 Certificate of Tax Deducted Section 203 Assessment Year TAN of Employer", "form16"),
        ("utility_bill.pdf", "Electricity Bill Consumer Number Units Consumed 350 kWh", "utility_bill"),
        ("property_agreement.pdf", "Agreement for Sale Vendor Purchaser Sale Consideration RERA", "property_agreement"),
        ("x.pdf", "nothing", "generic"),
    ]:
        c = spark.range(1).select(extract.classify(F.lit(name), F.lit(text)).alias("c")).first()["c"]
        assert c["type"] == want
    assert len(fixed.DOC_TYPES) == 15


def test_page_split(spark):
    rows = spark.createDataFrame([("a\fb\n\n\n\nc",), ("",), (None,)], "text string")
    assert [len(r["pages"]) for r in extract.pages_of_text(rows).collect()] == [3, 1, 1]


def test_model_reply(spark):
    reply = '```json\n{"fields": {"name": "A B", "pan": "abcde1234f", "dob": "n/a"}}\n```'
    row = spark.range(1).select(extract.json_reply(F.lit(reply), {"name": ["full_name", "name"], "pan": ["pan_number", "pan"], "dob": ["dob"]}).alias("r")).first()["r"]
    assert tuple(row) == ("A B", "abcde1234f", None)


def test_series(spark):
    d = datetime.date
    rows = [("p", d(2026, 1, 1), 1, 100000, 80000, 20000, 0, "A"), ("p", d(2026, 2, 1), 2, 140000, 95000, 45000, 2, "B"), ("q", d(2026, 1, 1), 1, 100, 100, 0, 0, "A"), ("q", d(2026, 4, 1), 2, 100, 40, 0, 0, "A"), ("q", None, 3, 100, 40, 0, 0, "A")]
    df = spark.createDataFrame(rows, "person string, period date, ord int, gross long, net long, deductions long, lop long, eid string")
    found = {(r["person"], r["type"], r["severity"], r["amount"]) for r in series.anomalies(df).collect()}
    assert found == {("p", "gross_earnings_variance", "medium", 40000), ("p", "deduction_spike", "medium", 25000), ("p", "lop_days_increase", "low", 2), ("q", "net_pay_drop_spike", "high", 60), ("q", "period_gap", "medium", 2)}
    assert [r["person"] for r in series.drift(df, "eid", "employee_id_drift", "high").collect()] == ["p"]
    assert {r["person"]: r["n_anomalies"] for r in series.summary(df).collect()} == {"p": 3, "q": 2}


def test_identity(spark):
    check = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert check(identity.name_check(F.lit("Asha Devi Rao"), F.lit("asha rao"))) is True
    assert check(identity.name_check(F.lit("Asha Rao"), F.lit("Asha Nair"))) is False
    assert check(identity.name_check(F.lit(""), F.lit("Asha"))) is None
    for a, b, want in [("12/08/1995", "1995-08-12", ("exact", True)), ("1995", "12/08/1995", ("year_only", True)), ("1995", "12/08/1994", ("year_only", False)), ("", "1995", ("missing", None)), ("soon", "1995", ("unparsed", None))]:
        assert tuple(check(identity.dob_check(F.lit(a), F.lit(b)))) == want
    vec = lambda *x: F.array(*map(F.lit, x))
    assert check(identity.face_match(vec(0.4, 0.0), vec(1.0, 0.0)))["matched"] and check(identity.face_match(vec(0.4), vec(1.0)))["display"] == 60.0
    assert check(identity.face_match(vec(0.39), vec(1.0)))["display"] == 59.3


def test_search_crosses_labels(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.6, 0.8], 2), (2, [0.0, 1.0], 1), (100, [0.8, 0.6], 3)], "vec_id long, embedding array<float>, label int")
    for block in (1, 4096):
        found = identity.embedding_search(df, F.col("vec_id") % 100 == 0, block=block).collect()
        assert sorted((r["query"], r["match"], r["score"]) for r in found) == [(0, 1, 0.6), (0, 100, 0.8), (100, 0, 0.8), (100, 1, 0.96), (100, 2, 0.6)]


def test_resolution(spark):
    schema = "first_name string, last_name string, pan string, aadhaar string"
    registry = spark.createDataFrame([("BT-000001", "A", "B", "P1", None), ("BT-000002", "C", "D", None, "X2")], f"entity_ref string, {schema}")
    people = spark.createDataFrame([(1, "z", "z", "p1", "X2"), (2, "z", "z", None, "x2"), (3, "a", "b", "P9", None), (4, "n", "n", None, None)], f"id long, {schema}")
    got = {r["id"]: (r["entity_ref"], r["matched_by"]) for r in entities.resolve(people, registry).collect()}
    assert got == {1: ("BT-000001", "pan"), 2: ("BT-000002", "aadhaar"), 3: ("BT-000001", "first_name+last_name"), 4: (None, None)}
    strict = {r["id"]: r["entity_ref"] for r in entities.resolve(people, registry, strict=True).collect()}
    assert strict[3] is None


def test_cases(spark):
    df = spark.createDataFrame([("payslip", {"employee_id": "NZ66"}, "a.pdf"), ("invoice", {}, "Bill 7.pdf")], "t string, k map<string,string>, s string")
    assert [r["c"] for r in df.select(extract.case_key(F.col("t"), F.col("k"), F.col("s")).alias("c")).collect()] == ["payslip::nz66", "invoice::bill_7"]
    events = spark.createDataFrame([("c", 1, "new", "open", None), ("c", 2, None, "cleared", "high"), ("c", 3, "triage", None, None)], "case_key string, ts int, status string, disposition string, priority string")
    state = cases.folded(events, columns=["status", "disposition", "priority"]).first()
    assert (state["status"], state["disposition"], state["priority"]) == ("triage", "cleared", "high")
    assert spark.range(1).select(cases.labels(F.array(F.lit(" b "), F.lit("a"), F.lit(""), F.lit("b"))).alias("x")).first()["x"] == ["a", "b"]


def test_reconciliation(spark):
    schema = "case_id long, role string, ord int, gross long, net long, annual long, salary_credit long, pan string, bank_name string"
    slips = [(1, "payslip", i, 100000, 80000, None, None, "ABCDE1234F", "HDFC Bank") for i in range(3)]
    rest = [(1, "form16", 5, None, None, 900000, None, "ZZZZZ9999Z", None), (1, "letter", 6, None, None, 1250000, None, None, None), (1, "bank", 7, None, None, None, None, None, "ICICI BANK"), (1, "gift", 8, None, None, 1800000, None, None, None), (2, "form16", 1, None, None, 1, None, None, None)]
    found = reconcile.evidence(spark.createDataFrame(slips + rest, schema))
    got = {(r["case_id"], r["type"], r["severity"]) for r in reconcile.checks(found).collect()}
    assert got == {(1, "payslip_vs_form16_salary_mismatch", "high"), (1, "offer_letter_vs_form16_salary_mismatch", "medium"), (1, "pan_mismatch_payslip_vs_form16", "high"), (1, "bank_name_payslip_vs_statement_mismatch", "high")}
    rows = spark.createDataFrame([(1, 1, 0, 1800000), (1, 2, 5, 0)], "case_id long, txn_no int, debit long, credit long")
    assert reconcile.gift_matches(found, rows).first()["n_matches"] == 1


def test_bundle_and_verdict(spark):
    docs = spark.createDataFrame([(1, "low"), (2, "medium")], "case_id long, risk_level string")
    found = spark.createDataFrame([(1, "critical"), (2, "high")], "case_id long, severity string")
    assert {r["case_id"]: r["bundle_risk"] for r in reports.bundle(docs, found).collect()} == {1: "low", 2: "high"}


def test_ledger_plan_filters_before_join(spark):
    rows = spark.createDataFrame([(1, datetime.date(2026, 1, 1), 1, 500000, 0), (1, datetime.date(2026, 1, 1), 2, 0, 500000)], "account long, txn_date date, txn_no int, debit long, credit long")
    assert ledger.round_trips(rows).first()["delta"] == 0


def test_large_case_keeps_all_documents(spark):
    reports = spark.range(1500).select(F.lit("c").alias("case_key"), F.col("id").alias("doc_id"), F.lit("low").alias("risk_level"), F.lit(50).alias("truth_score"), F.format_string("%06d", "id").alias("generated_at"))
    case = cases.grouped(reports).first()
    assert [x["doc_id"] for x in case["documents"]] == list(range(1499, -1, -1)) and case["n_documents"] == 1500


def test_long_chain_is_no_silent_split(spark):
    """Minima that haven't passed along the whole chain are an error."""
    chain = spark.range(9).select(F.col("id").alias("node"), F.expr("id div 2").alias("a"), F.expr("(id + 1) div 2").alias("b"))
    assert {r["cluster"] for r in clusters.shared_clusters(chain, "node", ["a", "b"]).collect()} == {0}


LETTER = """Infotech Works Limited
CIN: L22210MH2015PLC084781
Dated: 15 March 2026
TO WHOMSOEVER IT MAY CONCERN
This is to certify that Asha Person, bearing PAN ABCDE1234F, is an employee.
She serves as engineer, with effect from 20 September 2001.
Her current annual Cost-to-Company (CTC) is Rs. 11,10,000 per annum (Gross Monthly: Rs. 42,500).
Authorised Signatory, Head of HR department"""

STATEMENT = """HDFC BANK LTD
Bank Statement
XXXX XXXX 1234
IFSC HDFC0001234
01-Jan-2026 to 31-Mar-2026
Opening Balance   50,000
05-01-2026   SALARY CREDIT   REF1   30,000   80,000
12-02-2026   RENT   REF2   20,000   60,000
Closing Balance   60,000"""


def _scan(spark, text, name, **options):
    rows = extract.pages_of_text(spark.createDataFrame([(1, name, text)], "doc_id int, source_name string, text string"))
    found = extract.summaries(rows, **options).withColumns({"metadata": F.create_map().cast("map<string,string>"), "signature_markers": F.array().cast("array<string>")})
    row = rules.assess(found, F.lit("2026-04-01").cast("date")).select("doc_type", "key_fields", "signals", "risk_score").first()
    return row, {s["name"].removeprefix("domain::"): s["passed"] for s in row["signals"]}


def test_letter_from_text_to_rules(spark):
    row, said = _scan(spark, LETTER, "letter.pdf")
    assert row["doc_type"] == "employment_letter"
    assert row["key_fields"] == {"cin": "L22210MH2015PLC084781", "annual_ctc": "1110000", "gross_monthly_salary": "42500", "date_of_joining": "20 September 2001", "letter_issue_date": "15 March 2026", "employee_name": "Asha Person"}
    assert {k: said[k] for k in ("employer_cin_format", "cin_age_vs_join_date", "ctc_monthly_gross_consistency", "employment_backdating_signal")} == {"employer_cin_format": True, "cin_age_vs_join_date": False, "ctc_monthly_gross_consistency": False, "employment_backdating_signal": False}
    assert row["risk_score"] == 30 + 20 + 40


def test_statement_from_text_to_rules(spark):
    row, said = _scan(spark, STATEMENT, "s.pdf", parity=False)
    k = row["key_fields"]
    assert (k["account_number"], k["period_from"], k["period_to"], k["opening_balance"], k["closing_balance"]) == ("XXXX XXXX 1234", "01-Jan-2026", "31-Mar-2026", "50000", "60000")
    assert (k["credit_total"], k["debit_total"], k["earliest_txn_date"], k["latest_txn_date"]) == ("30000", "20000", "05-01-2026", "12-02-2026")
    assert said["balance_arithmetic"] is True and said["bank_ifsc_bank_name_consistency"] is True
    assert said["bank_statement_date_range"] is False and said["bank_debit_credit_arithmetic"] is True
    # by parity the totals keep the names that rules don't know
    assert "balance_arithmetic" not in _scan(spark, STATEMENT, "s.pdf")[1]


@pytest.mark.parametrize(
    ("text", "fields"),
    [
        ("GIFT DECLARATION\nDate: 10 March 2026\nI have gifted a sum of Rs. 18,00,000 to him. The property value is Rs. 20,00,000.\nABCDE9999Z\nPAN: YLSFF4758H", {"gift_amount": "1800000", "property_value": "2000000", "donor_pan": "YLSFF4758H", "letter_date": "10 March 2026"}),
        ("GIFT DECLARATION\nthis is a gift of 9,000\na sum of 50,000 and ABCDE9999Z", {}),
    ],
)
def test_gift_letters(spark, text, fields):
    assert _scan(spark, text, "gift.pdf")[0]["key_fields"] == fields
