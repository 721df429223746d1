import pytest
from pyspark.sql import functions as F

from docsleuth.operators import ledger, rules

SCHEMA = f"doc_type string, key_fields map<string,string>, metadata map<string,string>, signature_markers array<string>, dates array<string>, transactions {ledger.TRANSACTIONS}"


def signals(spark, doc_type, fields, transactions=(), metadata=None, as_of="2026-04-01"):
    row = (doc_type, {k: str(v) for k, v in fields.items()}, metadata or {}, [], [], list(transactions))
    out = rules.assess(spark.createDataFrame([row], SCHEMA), F.lit(as_of).cast("date")).first()
    return out, {s["name"].removeprefix("domain::"): s["score"] for s in out["signals"] if not s["passed"] and s["name"].startswith("domain::")}


def pack(spark, made, fields, transactions=()):
    row = ("x", {k: str(v) for k, v in fields.items()}, {}, [], [], list(transactions))
    df = rules.with_fields(spark.createDataFrame([row], SCHEMA))
    return {s["name"]: s["score"] for s in df.select(rules.fired(made).alias("s")).first()["s"] if not s["passed"]}


SLIP = {"gross_earnings": 80000, "net_pay": 65000, "basic_salary": 32000, "hra": 12800, "pf": 3840, "professional_tax": 200, "tds": 4000}


@pytest.mark.parametrize(
    ("change", "failing"),
    [
        ({}, {}),
        ({"pf": 5000}, {"pf_rate_validity": 15}),
        ({"professional_tax": 500}, {"pt_slab_validity": 15}),
        ({"gross_earnings": 70000, "tds": 0}, {"tds_plausibility": 20}),
        ({"hra": 40000}, {"hra_proportion": 15, "hra_basic_proportion": 50}),
    ],
)
def test_mortgage_payslip(spark, change, failing):
    assert signals(spark, "mortgage_payslip", SLIP | change)[1] == failing


@pytest.mark.parametrize(
    ("change", "failing"),
    [({}, {}), ({"net_pay": 60000}, {"gross_gte_net_pay": 55}), ({"uan": 12345}, {"uan_format": 5}), ({"paid_days": 45}, {"paid_days_range": 20}), ({"gross_earnings": 100000, "net_pay": 80000, "basic": 5000}, {"basic_minimum_proportion": 15})],
)
def test_payroll(spark, change, failing):
    base = {"gross_earnings": 50000, "net_pay": 42000, "basic": 25000, "paid_days": 22, "uan": 100123456789, "employee_name": "A B", "employee_id": "E001"}
    assert pack(spark, rules.payroll(), base | change) == failing


def test_editor_and_score(spark):
    fields = {"gross_earnings": 10000, "total_deductions": 1000, "net_pay": 9000, "net_pay_in_words": "Nine Thousand", "employee_id": "X1", "employee_name": "A"}
    row, _ = signals(spark, "payslip", fields, metadata={"Producer": "Adobe Photoshop 2024"})
    failed = [s["name"] for s in row["signals"] if s["name"] == "editor_software_mismatch" and not s["passed"]]
    assert failed and (row["risk_score"], row["truth_score"], row["risk_level"]) == (35, 65, "medium")


def txn(date, desc, ref, debit=0, credit=0, balance=None):
    return (date, desc, ref, debit, credit, balance)


CLEAN = [txn("01-01-2026", "SALARY CREDIT payroll", "NEFT001", credit=80000), txn("05-01-2026", "EMI", "NACH001", debit=20000), txn("09-01-2026", "shop", "UPI001", debit=500)]


@pytest.mark.parametrize(
    ("more", "failing"),
    [
        ([], {}),
        ([txn("15-01-2026", "out", "A", debit=500000), txn("15-01-2026", "in", "B", credit=500000)], {"circular_funds_detection": 40}),
        ([txn("15-01-2026", "out", "A", debit=100000), txn("15-01-2026", "in", "B", credit=102000)], {"circular_funds_detection": 40}),
        ([txn("15-01-2026", "out", "A", debit=100000), txn("15-01-2026", "in", "B", credit=102001)], {}),
        ([txn("15-01-2026", "out", "A", debit=99999), txn("15-01-2026", "in", "B", credit=99999)], {}),
        ([txn("20-01-2026", "x", "NEFT001", debit=1)], {"duplicate_txn_reference": 35}),
        ([txn("15-01-2026", "SALARY CREDIT payroll", "C", credit=1)], {"salary_credit_regularity": 20}),
    ],
)
def test_banking(spark, more, failing):
    fields = {"account_number": "1", "statement_period": "x", "opening_balance": 10000, "total_credits": 5000, "total_debits": 3000, "closing_balance": 12000}
    assert pack(spark, rules.banking(), fields, CLEAN + more) == failing
    assert pack(spark, rules.banking(), fields | {"closing_balance": 15000}, CLEAN) == {"balance_arithmetic": 60}


@pytest.mark.parametrize(("second", "failing"), [(65000, {"bank_debit_credit_arithmetic": 65}), (56789, {}), (45400, {})])
def test_running_balance(spark, second, failing):
    rows = [txn("01-01-2026", "a", "1", balance=50000), txn("02-01-2026", "b", "2", debit=5000, balance=second)]
    assert signals(spark, "bank_statement", {}, rows)[1] == failing


def test_bank_name_and_range(spark):
    assert signals(spark, "bank_statement", {"ifsc": "ICIC0009999", "bank_name": "HDFC BANK"})[1] == {"bank_ifsc_bank_name_consistency": 65}
    assert signals(spark, "bank_statement", {"ifsc": "ZZZZ0000001", "bank_name": "HDFC BANK"})[1] == {}
    fields = {"period_from": "01-Oct-2025", "period_to": "31-Mar-2026", "earliest_txn_date": "02-01-2026", "latest_txn_date": "30-03-2026"}
    assert signals(spark, "bank_statement", fields)[1] == {"bank_statement_date_range": 65}


@pytest.mark.parametrize(
    ("change", "failing"),
    [({}, {}), ({"cin": "INVALID123"}, {"employer_cin_format": 35}), ({"cin": ""}, {"employer_cin_present": 35}), ({"cin": "L85110KA2023PLC013341"}, {"cin_age_vs_join_date": 30}), ({"letter_issue_date": "15 March 2026", "date_of_joining": "01 April 2000"}, {"employment_backdating_signal": 40}), ({"letter_issue_date": "15 March 2026", "date_of_joining": "01 April 2016"}, {})],
)
def test_employment_letter(spark, change, failing):
    base = {"cin": "L85110KA1981PLC013341", "date_of_joining": "15-06-2022", "annual_ctc": 1200000, "gross_monthly_salary": 100000}
    assert signals(spark, "employment_letter", base | change)[1] == failing


def test_other_packs(spark):
    invoice = {"invoice_number": "INV-001", "amount_due": 11800, "subtotal": 10000, "tax_amount": 1800}
    assert signals(spark, "invoice", invoice)[1] == {}
    assert signals(spark, "invoice", invoice | {"amount_due": 99999})[1] == {"invoice_amount_arithmetic": 50}
    assert signals(spark, "form16", {"tan": "PUNE12345E", "gross_salary": 900000, "tds": 0})[1]["form16_tds_plausibility"] == 20
    assert signals(spark, "form16", {"tan": "BADTAN", "gross_salary": 600000, "tds": 10000})[1] == {"tan_format_validity": 15}
    assert signals(spark, "generic", {})[1] == {}


def test_user_pack(spark):
    rules.register_pack("ticket", lambda: [rules.only_failure("no_seat", rules.text("seat").isNull(), "low", 7, "There is a seat.")])
    try:
        assert signals(spark, "ticket", {})[1] == {"no_seat": 7}
    finally:
        rules._USER_PACKS.clear()


def test_scoring_has_no_python(spark):
    row = ("payslip", {}, {}, [], [], [])
    plan = rules.assess(spark.createDataFrame([row], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
