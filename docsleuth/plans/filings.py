"""Queries of the rule packs over filings: orders as payments, policies, bills, invoices, audits, letters, tax forms, and ledgers as statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.operators import ledger, rules
from docsleuth.plans import views as V
from docsleuth.plans.registry import SQL, query

#: The day that rules about the future and recent letters are asked for.
AS_OF = "1998-06-30"


def orders(spark: SparkSession, d: str) -> DataFrame:
    """k, t, day: number, rounded total and day of each order."""
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), V.whole(F.col("o_totalprice")).alias("t"), F.col("o_orderdate").cast("date").alias("day"))


ORDERS = "v_order AS (SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS t, CAST(o_orderdate AS DATE) AS day FROM orders)"


def pick(*cases: object, by: str = "k") -> Column:
    """The case of a number's remainder; null, a text or a column each."""
    out = None
    for i, c in enumerate(cases):
        c = (F.lit(c) if isinstance(c, str) or c is None else c).cast("string")
        hit = F.col(by) % len(cases) == i
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out


def filing(df: DataFrame, doc_type: str, rows: Column | None = None, **fields: Column) -> DataFrame:
    """doc_id, doc_type, key_fields and the other columns that rules ask for; null fields are left out. rows: a statement's ledger."""
    pairs = [x for n, v in fields.items() for x in (F.lit(n), v.cast("string"))]
    known = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    none = F.array().cast("array<string>")
    return V.spread(df, "k").select(F.col("k").alias("doc_id"), F.lit(doc_type).alias("doc_type"), known.alias("key_fields"), F.create_map().cast("map<string,string>").alias("metadata"), none.alias("signature_markers"), none.alias("dates"), (F.array() if rows is None else rows).cast(ledger.TRANSACTIONS).alias("transactions"))


def signals(df: DataFrame, found: Column) -> DataFrame:
    # the signals are a column first: an explode of their expression would have all fields of all packs computed below it
    one = rules.with_fields(df).select("doc_id", found.alias("found")).select("doc_id", F.explode_outer("found").alias("s")).where("s is not null")
    return one.select("doc_id", "s.name", "s.severity", F.col("s.score").cast("bigint").alias("score"), "s.passed")


def signal_sql(view: str, *rows: tuple[str, str, str, str, str]) -> str:
    """rows: name, when it applies, when it passes, severity and score as SQL."""
    return " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, CASE WHEN ({ok}) THEN 'info' ELSE {sev} END AS severity, CAST(CASE WHEN ({ok}) THEN 0 ELSE {score} END AS BIGINT) AS score, ({ok}) AS passed FROM {view} WHERE {applies}" for n, applies, ok, sev, score in rows)


def required_sql(view: str, *fields: str) -> tuple[str, str, str, str, str]:
    missing = " + ".join(f"CASE WHEN coalesce({f}, '') = '' THEN 1 ELSE 0 END" for f in fields)
    return "required_fields_present", "true", f"{missing} = 0", "'medium'", f"least(30, 8 * ({missing}))"


# payments, insurance, healthcare, invoices, compliance

_PAYMENT = ORDERS + """, v_payment AS (SELECT k AS doc_id, CASE WHEN t % 3 = 0 THEN 'Rs ' || (t - 150000) WHEN t % 3 = 1 THEN CAST(t AS VARCHAR) END AS amount_text,
  CASE WHEN t % 3 = 0 THEN t - 150000 WHEN t % 3 = 1 THEN t END AS amount, CASE k % 4 WHEN 0 THEN '' WHEN 2 THEN 'T' || k WHEN 3 THEN '  ' END AS transaction_id,
  CASE k % 3 WHEN 1 THEN '   ' WHEN 2 THEN 'R' || k END AS reference_number, CASE k % 5 WHEN 0 THEN NULL ELSE CAST(day AS VARCHAR) END AS payment_date,
  CASE k % 3 WHEN 0 THEN 'u.' || k || '@okbank' WHEN 1 THEN 'no at sign ' || k END AS upi_id FROM v_order)"""


@query(
    signal_sql(
        "v_payment",
        required_sql("v_payment", "transaction_id", "amount_text", "payment_date"),
        ("amount_positive", "amount IS NOT NULL", "amount > 0", "'high'", "50"),
        ("upi_id_format", "upi_id IS NOT NULL", "k_ok", "'low'", "5"),
        ("transaction_ref_not_empty", "coalesce(transaction_id, reference_number) IS NOT NULL", "trim(coalesce(transaction_id, reference_number)) <> ''", "'medium'", "25"),
    ).replace("k_ok", "regexp_full_match(upi_id, '[a-zA-Z0-9._+-]+@[a-zA-Z0-9]+')"),
    _PAYMENT,
)
def payment_signals(spark: SparkSession, d: str) -> DataFrame:
    """R01, R13-R15."""
    amount = pick(F.concat(F.lit("Rs "), (F.col("t") - 150_000).cast("string")), F.col("t"), None, by="t")
    df = filing(orders(spark, d), "payment_receipt", amount=amount, transaction_id=pick("", None, F.concat(F.lit("T"), "k"), "  "), reference_number=pick(None, "   ", F.concat(F.lit("R"), "k")), payment_date=pick(None, *[F.col("day")] * 4), upi_id=pick(F.concat(F.lit("u."), "k", F.lit("@okbank")), F.concat(F.lit("no at sign "), "k"), None))
    return signals(df, rules.domain_signals(F.lit(AS_OF).cast("date")))


_INSURANCE = ORDERS + """, v_policy AS (SELECT k AS doc_id, CASE k % 4 WHEN 1 THEN 'P 1 2' WHEN 2 THEN '' WHEN 3 THEN 'POL 0' || k END AS policy_number,
  CASE k % 3 WHEN 1 THEN t - 100000 WHEN 2 THEN 0 END AS claim_amount, CASE k % 2 WHEN 1 THEN t END AS sum_insured, CASE k % 5 WHEN 0 THEN '' ELSE 'N' END AS insured_name, 'I' AS insurer_name FROM v_order)"""


@query(
    signal_sql(
        "v_policy",
        required_sql("v_policy", "policy_number", "insured_name", "insurer_name"),
        ("policy_number_format", "policy_number IS NOT NULL", r"length(regexp_replace(policy_number, '\s', '', 'g')) >= 6", "'medium'", "20"),
        ("claim_amount_positive", "coalesce(claim_amount, sum_insured) IS NOT NULL", "coalesce(claim_amount, sum_insured) > 0", "'high'", "40"),
    ),
    _INSURANCE,
)
def insurance_signals(spark: SparkSession, d: str) -> DataFrame:
    """R01, R16, R17."""
    df = filing(orders(spark, d), "insurance", policy_number=pick(None, "P 1 2", "", F.concat(F.lit("POL 0"), "k")), claim_amount=pick(None, F.col("t") - 100_000, "0"), sum_insured=pick(None, F.col("t")), insured_name=pick("", *["N"] * 4), insurer_name=F.lit("I"))
    return signals(df, rules.domain_signals(F.lit(AS_OF).cast("date")))


_HEALTH = ORDERS + """, v_bill AS (SELECT k AS doc_id, t AS subtotal, t // 10 AS taxes, CASE k % 4 WHEN 0 THEN t + t // 10 WHEN 1 THEN t + t // 10 + 400 WHEN 2 THEN t - 5000 END AS total,
  CASE k % 3 WHEN 1 THEN '' WHEN 2 THEN 'PX' || k END AS patient_id, CASE k % 7 WHEN 0 THEN NULL ELSE 'N' END AS patient_name, 'H' AS provider_name, CAST(day AS VARCHAR) AS visit_date FROM v_order)"""


@query(
    signal_sql(
        "v_bill",
        required_sql("v_bill", "patient_name", "provider_name", "visit_date"),
        ("bill_arithmetic", "total IS NOT NULL", "abs(subtotal + taxes - total) <= greatest(5, CAST(trunc(abs(total) * 0.005) AS BIGINT))", "'high'", "50"),
        ("patient_id_not_empty", "patient_id IS NOT NULL", "trim(patient_id) <> ''", "'low'", "5"),
    ),
    _HEALTH,
)
def healthcare_signals(spark: SparkSession, d: str) -> DataFrame:
    """R01, R18, R19."""
    t, tax = F.col("t"), F.expr("t div 10")
    df = filing(orders(spark, d), "healthcare", subtotal=t, taxes=tax, total=pick(t + tax, t + tax + 400, t - 5000, None), patient_id=pick(None, "", F.concat(F.lit("PX"), "k")), patient_name=pick(None, *["N"] * 6), provider_name=F.lit("H"), visit_date=F.col("day"))
    return signals(df, rules.domain_signals(F.lit(AS_OF).cast("date")))


_INVOICE = ORDERS + """, v_invoice AS (SELECT k AS doc_id, 'I' || k AS invoice_number, t AS subtotal, t * 18 // 100 AS tax_amount, t + t * 18 // 100 + k % 6 AS due, CASE k % 9 WHEN 0 THEN '' ELSE CAST(t + t * 18 // 100 + k % 6 AS VARCHAR) END AS amount_due,
  coalesce(CASE k % 4 WHEN 0 THEN '27ABCDE1234F1Z5' WHEN 1 THEN '27abcde1234f1z5' WHEN 2 THEN '27ABCDE12' END, CASE k % 8 WHEN 3 THEN '29PQRST9876K2ZA' END) AS gstin FROM v_order)"""


@query(
    signal_sql(
        "v_invoice",
        required_sql("v_invoice", "invoice_number", "amount_due"),
        ("invoice_amount_arithmetic", "amount_due <> ''", "abs(subtotal + tax_amount - due) <= 2", "'high'", "50"),
        ("gstin_format", "gstin IS NOT NULL", "regexp_full_match(upper(gstin), '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]')", "'medium'", "15"),
    ),
    _INVOICE,
)
def invoice_signals(spark: SparkSession, d: str) -> DataFrame:
    """R01, R20, R21."""
    t, tax = F.col("t"), F.expr("t * 18 div 100")
    df = filing(orders(spark, d), "invoice", invoice_number=F.concat(F.lit("I"), "k"), subtotal=t, tax_amount=tax, amount_due=pick("", *[t + tax + F.col("k") % 6] * 8), gstin=pick("27ABCDE1234F1Z5", "27abcde1234f1z5", "27ABCDE12", ""), gst_number=F.when(F.col("k") % 8 == 3, "29PQRST9876K2ZA"))
    return signals(df, rules.domain_signals(F.lit(AS_OF).cast("date")))


_AUDIT = ORDERS + """, v_audit AS (SELECT k AS doc_id, 'Audit' AS report_title, CASE k % 6 WHEN 0 THEN '' ELSE 'A' END AS auditor_name, CASE k % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(day AS VARCHAR) END AS report_date,
  CASE WHEN k % 5 > 1 THEN day END AS reported, coalesce(CASE k % 3 WHEN 1 THEN ' ' WHEN 2 THEN 'FY' END, CASE k % 2 WHEN 1 THEN 'Q1' END) AS period FROM v_order)"""


@query(
    signal_sql(
        "v_audit",
        required_sql("v_audit", "report_title", "auditor_name", "report_date"),
        ("date_not_future", "reported IS NOT NULL", f"reported <= DATE '{AS_OF}'", "'medium'", "20"),
        ("period_present", "period IS NOT NULL", "trim(period) <> ''", "'low'", "5"),
    ),
    _AUDIT,
)
def compliance_signals(spark: SparkSession, d: str) -> DataFrame:
    """R01, R22, R23."""
    df = filing(orders(spark, d), "compliance", report_title=F.lit("Audit"), auditor_name=pick("", *["A"] * 5), report_date=pick("n/a", None, *[F.col("day")] * 3), audit_period=pick(None, " ", "FY"), coverage_period=pick(None, "Q1"))
    return signals(df, rules.domain_signals(F.lit(AS_OF).cast("date")))


def parking() -> list[rules.Rule]:
    """A pack as a user would write one."""
    fee, plate = rules.num("fee"), rules.text("plate")
    return [rules.required(["plate", "fee"]), rules.signal("fee_is_small", fee.isNotNull(), fee <= 150_000, "medium", 30, "The fee is small.", fee=fee), rules.signal("plate_format", plate.isNotNull(), plate.rlike("^[A-Z]{2}[0-9]+$"), "low", 10, "The plate has its format.", plate=plate)]


_PARKING = ORDERS + """, v_park AS (SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN 'MH' || k WHEN 1 THEN 'x' || k END AS plate, CASE k % 4 WHEN 0 THEN NULL ELSE t END AS fee FROM v_order)"""


@query(signal_sql("v_park", required_sql("v_park", "plate", "CAST(fee AS VARCHAR)"), ("fee_is_small", "fee IS NOT NULL", "fee <= 150000", "'medium'", "30"), ("plate_format", "plate IS NOT NULL", "regexp_full_match(plate, '[A-Z]{2}[0-9]+')", "'low'", "10")), _PARKING)
def user_pack_signals(spark: SparkSession, d: str) -> DataFrame:
    """Rules for a type of the user's, registered at run time."""
    rules.register_pack("parking_receipt", parking)
    k, t = F.col("k"), F.col("t")
    df = filing(orders(spark, d), "parking_receipt", plate=pick(F.concat(F.lit("MH"), k), F.concat(F.lit("x"), k), None), fee=pick(None, t, t, t))
    return signals(df, rules.domain_signals(F.lit(AS_OF).cast("date"), types=["parking_receipt"]))


# employment letters, tax forms, utility bills

_LETTER = ORDERS + f""", v_letter AS (SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'U72200MH' || (1985 + k % 17) || 'PTC' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') WHEN 1 THEN 'u72200mh' || (1985 + k % 17) || 'ptc' || lpad(CAST(k % 1000000 AS VARCHAR), 6, '0') WHEN 2 THEN 'X12' END AS cin,
  1985 + k % 17 AS born, CASE k % 3 WHEN 0 THEN NULL ELSE t * 12 END AS ctc, CASE k % 5 WHEN 0 THEN NULL ELSE t + (k % 5 - 2) * 20000 END AS gross,
  CASE k % 4 WHEN 3 THEN NULL ELSE CAST(day - to_years(CAST(k % 19 AS INT)) AS DATE) END AS joined, CASE k % 7 WHEN 0 THEN NULL ELSE day END AS issued FROM v_order)"""
_LETTER_GATE = "(cin IS NOT NULL OR ctc IS NOT NULL OR gross IS NOT NULL OR joined IS NOT NULL)"
_CIN = "regexp_full_match(upper(cin), '[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{2,4}[0-9]{6}')"


@query(
    signal_sql(
        "v_letter",
        ("employer_cin_format", "cin IS NOT NULL", _CIN, "'high'", "35"),
        ("employer_cin_present", f"cin IS NULL AND {_LETTER_GATE}", "false", "'high'", "35"),
        ("cin_age_vs_join_date", f"cin IS NOT NULL AND {_CIN} AND joined IS NOT NULL", "born <= year(joined)", "'high'", "30"),
        ("ctc_monthly_gross_consistency", "ctc IS NOT NULL AND gross IS NOT NULL", "abs(ctc / 12 - gross) <= greatest(5000, CAST(trunc(abs(ctc / 12) * 0.15) AS BIGINT))", "'medium'", "20"),
        ("employment_backdating_signal", "joined IS NOT NULL AND issued IS NOT NULL AND issued > joined", f"NOT (date_diff('day', issued, DATE '{AS_OF}') BETWEEN 0 AND 365 AND date_diff('day', joined, issued) / 365.25 >= 12)", "'high'", "40"),
    ),
    _LETTER,
)
def employment_signals(spark: SparkSession, d: str) -> DataFrame:
    """R43-R47."""
    k, t = F.col("k"), F.col("t")
    number = F.concat((1985 + k % 17).cast("string"), F.lit("PTC"), F.lpad((k % 1_000_000).cast("string"), 6, "0"))
    joined = F.date_format(F.add_months("day", (-12 * (k % 19)).cast("int")), "d-M-yyyy")
    df = filing(orders(spark, d), "employment_letter", cin=pick(F.concat(F.lit("U72200MH"), number), F.lower(F.concat(F.lit("U72200MH"), number)), "X12", None), annual_ctc=pick(None, t * 12, t * 12), gross_monthly_salary=pick(None, *[t + (k % 5 - 2) * 20_000] * 4), date_of_joining=pick(joined, joined, joined, None), letter_issue_date=pick(None, *[F.date_format("day", "d MMMM yyyy")] * 6))
    return signals(df, rules.domain_signals(F.lit(AS_OF).cast("date")))


_TAX = ORDERS + """, v_tax AS (SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'ABCD12345E' WHEN 1 THEN 'abcd12345e' WHEN 2 THEN 'AB12' END AS tan, CASE k % 5 WHEN 0 THEN 0 ELSE t * 6 END AS gross, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN t // 10 END AS tds FROM v_order),
v_bill AS (SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN t // 10 WHEN 1 THEN k % 300 END AS amount FROM v_order)"""


@query(
    signal_sql("v_tax", ("tan_format_validity", "tan IS NOT NULL", "regexp_full_match(upper(tan), '[A-Z]{4}[0-9]{5}[A-Z]')", "'medium'", "15"), ("form16_tds_plausibility", "gross <> 0 AND tds IS NOT NULL", "NOT (gross > 700000 AND tds = 0)", "'medium'", "20"))
    + " UNION ALL "
    + signal_sql("v_bill", ("utility_amount_plausibility", "amount IS NOT NULL", "amount BETWEEN 100 AND 20000", "'low'", "10")),
    _TAX,
)
def tax_and_utility_signals(spark: SparkSession, d: str) -> DataFrame:
    """R48-R50."""
    t = F.col("t")
    tax = filing(orders(spark, d), "form16", tan=pick("ABCD12345E", "abcd12345e", "AB12", None), gross_salary=pick("0", *[t * 6] * 4), tds=pick("0", F.expr("t div 10"), None))
    bill = filing(orders(spark, d), "utility_bill", amount=pick(F.expr("t div 10"), "", None), bill_amount=pick(None, F.col("k") % 300, None))
    return signals(tax.unionByName(bill), rules.domain_signals(F.lit(AS_OF).cast("date")))


# payroll and banking packs

@query(
    signal_sql(
        "v_slip",
        ("required_fields_present", "true", "false", "'medium'", "8"),
        ("gross_gte_net_pay", "true", "gross >= net AND net > 0", "'high'", "55"),
        ("uan_format", "person % 3 > 0", "person % 3 = 1", "'low'", "5"),
        ("paid_days_range", "true", "days BETWEEN 0 AND 31", "'medium'", "20"),
        ("basic_minimum_proportion", "gross > 0", "basic / gross >= 0.20", "'medium'", "15"),
    ).replace("doc_id", "person AS doc_id, CAST(period AS VARCHAR) AS period")
    + " UNION ALL SELECT person, CAST(period AS VARCHAR), 'net_pay_zero_with_positive_gross', 'high', 50, false FROM v_slip WHERE false",
    V.SLIPS,
)
def payroll_signals(spark: SparkSession, d: str) -> DataFrame:
    """The payroll pack over payslips."""
    found = rules.fired(rules.payroll())
    rows = rules.with_fields(V.slips(spark, d).withColumn("key_fields", F.map_filter(F.map_concat("key_fields", F.create_map(F.lit("uan"), F.when(F.col("person") % 3 == 1, "1001 6537 1521").when(F.col("person") % 3 == 2, "12345"))), lambda _, v: v.isNotNull())))
    one = rows.select(F.col("person").alias("doc_id"), F.col("period").cast("string").alias("period"), F.explode_outer(found).alias("s")).where("s is not null")
    return one.select("doc_id", "period", "s.name", "s.severity", F.col("s.score").cast("bigint").alias("score"), "s.passed")


def heads(df: DataFrame, rows: Column | None = None) -> DataFrame:
    """Header fields of statements (k, debits, credits, first, last) that agree with their ledgers or not."""
    close = 10_000_000 + F.col("credits") - F.col("debits")
    return filing(
        df,
        "bank_statement",
        rows,
        opening_balance=F.lit(10_000_000),
        total_credits=F.col("credits"),
        total_debits=F.col("debits"),
        closing_balance=pick(close, close + 5, close + 5_000_000, None),
        account_number=pick(None, "XX123"),
        statement_period=F.lit("all"),
        ifsc_code=pick("HDFC0001234", "SBIN0000456", "ZZZZ0000001", "BAD", None),
        bank_name=pick("HDFC Bank Ltd", "State Bank of India", "Axis Bank"),
        earliest_transaction_date=F.date_format("first", "dd-MM-yyyy"),
        latest_transaction_date=F.date_format("last", "dd/MM/yyyy"),
        period_from=F.date_format(F.date_sub("first", (F.col("k") % 40).cast("int")), "d MMM yyyy"),
        period_to=F.date_format(F.date_add("last", (F.col("k") % 25).cast("int")), "d MMMM yyyy"),
    )


def statements(spark: SparkSession, d: str) -> DataFrame:
    """A statement for each account: ledger rows ten times as large, signups as salaries, and header fields that agree with them or not."""
    k = F.col("account")
    row = F.struct("txn_date", "txn_no", F.date_format("txn_date", "dd-MM-yyyy").alias("date"), F.when(F.col("desc") == "signup", "Salary credit").otherwise(F.col("desc")).alias("desc"), "ref", (F.col("debit") * 10).alias("debit"), (F.col("credit") * 10).alias("credit"), (F.col("balance") * 10).alias("balance"))
    t = V.balances(spark, d).groupBy("account").agg(F.array_sort(F.collect_list(row)).alias("t"), F.sum(F.col("debit") * 10).alias("debits"), F.sum(F.col("credit") * 10).alias("credits"), F.min("txn_date").alias("first"), F.max("txn_date").alias("last"))
    rows = F.transform("t", lambda x: F.struct(*[x[c].alias(c) for c in ("date", "desc", "ref", "debit", "credit", "balance")]))
    return heads(t.withColumn("k", k), rows)


def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same ledger as a table of rows."""
    times = {c: F.col(c) * 10 for c in ("debit", "credit", "balance")}
    return V.balances(spark, d).withColumns(times | {"desc": F.when(F.col("desc") == "signup", "Salary credit").otherwise(F.col("desc"))})


def statement_heads(spark: SparkSession, d: str) -> DataFrame:
    """The same statements without their ledgers: what is said of them, and the findings of the table."""
    rows = statement_rows(spark, d)
    found = ledger.coverage(rows)
    return heads(found.select(F.col("account").alias("k"), F.col("debit_total").alias("debits"), F.col("credit_total").alias("credits"), F.col("first_date").alias("first"), F.col("last_date").alias("last"))).drop("transactions").join(ledger.findings(rows, ranges=24).withColumnRenamed("account", "doc_id"), "doc_id")


STATEMENTS = V.BALANCES + """, v_rows AS (SELECT account AS doc_id, txn_date, txn_no, CASE WHEN descr = 'signup' THEN 'salary' ELSE descr END AS descr, ref, debit * 10 AS debit, credit * 10 AS credit, balance * 10 AS balance FROM v_balance),
v_pairs AS (SELECT DISTINCT a.doc_id FROM v_rows a JOIN v_rows b ON a.doc_id = b.doc_id AND a.txn_date = b.txn_date WHERE a.debit >= 100000 AND b.credit >= 100000 AND abs(a.debit - b.credit) * 100 <= a.debit * 2),
v_refs AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, trim(ref) AS r FROM v_rows WHERE trim(ref) <> '') GROUP BY doc_id, r HAVING count(*) > 1),
v_months AS (SELECT DISTINCT doc_id FROM v_rows WHERE descr = 'salary' GROUP BY doc_id, strftime(txn_date, '%Y-%m') HAVING count(*) > 1),
v_diff AS (SELECT doc_id, arg_min(diff, [CAST(txn_date - DATE '1970-01-01' AS BIGINT), txn_no]) AS diff FROM (SELECT *, abs(balance - expected) AS diff FROM (SELECT *, lag(balance) OVER (PARTITION BY doc_id ORDER BY txn_date, txn_no) + credit - debit AS expected FROM v_rows)) WHERE diff > greatest(500, CAST(trunc(abs(expected) * 0.01) AS BIGINT)) GROUP BY doc_id),
v_st AS (SELECT *, close_ok + CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 5000000 END AS closing, CASE doc_id % 5 WHEN 0 THEN 'HDFC0001234' WHEN 1 THEN 'SBIN0000456' WHEN 2 THEN 'ZZZZ0000001' WHEN 3 THEN 'BAD' END AS ifsc, CASE doc_id % 3 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'STATE BANK' ELSE 'AXIS' END AS bank,
  doc_id % 40 AS late, doc_id % 25 AS early FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (descr = 'salary') AS salaries, CAST(10000000 + sum(credit) - sum(debit) AS BIGINT) AS close_ok FROM v_rows GROUP BY doc_id))"""
_BALANCE = ("balance_arithmetic", "closing IS NOT NULL", "abs(close_ok - closing) <= greatest(10, CAST(trunc(abs(closing) * 0.01) AS BIGINT))", "'high'", "60")
_LEDGER_SIGNALS = [
    ("circular_funds_detection", "n > 0", "doc_id NOT IN (SELECT doc_id FROM v_pairs)", "'high'", "40"),
    ("duplicate_txn_reference", "n > 0", "doc_id NOT IN (SELECT doc_id FROM v_refs)", "'high'", "35"),
    ("salary_credit_regularity", "salaries > 0", "doc_id NOT IN (SELECT doc_id FROM v_months)", "'medium'", "20"),
]


@query(
    signal_sql(
        "v_st",
        ("required_fields_present", "true", "doc_id % 2 = 1", "'medium'", "8"),
        _BALANCE,
        ("ifsc_format", "ifsc IS NOT NULL", "ifsc <> 'BAD'", "'low'", "5"),
        ("overdraft_flag", "closing < 0", "false", "'low'", "5"),
        *_LEDGER_SIGNALS,
    ),
    STATEMENTS,
)
def banking_signals(spark: SparkSession, d: str) -> DataFrame:
    """The banking pack over statements."""
    return signals(statements(spark, d), rules.fired(rules.banking()))


@query(
    signal_sql(
        "v_st",
        _BALANCE,
        ("bank_ifsc_bank_name_consistency", "ifsc IN ('HDFC0001234', 'SBIN0000456')", "CASE WHEN ifsc = 'HDFC0001234' THEN bank = 'HDFC' ELSE bank = 'STATE BANK' END", "'high'", "65"),
        *_LEDGER_SIGNALS,
        ("bank_statement_date_range", "true", "late <= 20 AND early <= 20", "'high'", "65"),
        ("bank_debit_credit_arithmetic", "n >= 2", "doc_id NOT IN (SELECT doc_id FROM v_diff WHERE diff >= 10000 AND diff % 1000 = 0)", "'critical'", "65"),
    ),
    STATEMENTS,
)
def statement_signals(spark: SparkSession, d: str) -> DataFrame:
    """R36-R42, J08, V04."""
    return signals(statements(spark, d), rules.domain_signals(F.lit(AS_OF).cast("date")))


@query(SQL["statement_signals"])
def ranged_statement_signals(spark: SparkSession, d: str) -> DataFrame:
    """R36-R42 where a ledger has any number of rows: findings of the table in place of an array."""
    return signals(statement_heads(spark, d), rules.domain_signals(F.lit(AS_OF).cast("date"), types=["bank_statement"]))


@query(SQL["banking_signals"])
def ranged_banking_signals(spark: SparkSession, d: str) -> DataFrame:
    """R07-R12 over such statements."""
    return signals(statement_heads(spark, d), rules.fired(rules.banking()))


# rules of every document, and of images

_CORE = ORDERS + """, v_doc AS (SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN 'payslip' WHEN 1 THEN 'bank_statement' ELSE 'gift_letter' END AS kind, CASE k % 5 WHEN 0 THEN 'Adobe Photoshop 2024' WHEN 1 THEN 'made with CANVA' WHEN 2 THEN 'Writer' END AS maker, k % 4 = 0 AS signed, k % 9 AS n_dates,
  CASE k % 4 WHEN 0 THEN 'Seventy Six Thousand Six Hundred Thirty' WHEN 1 THEN 'five zillion' WHEN 2 THEN 'Nine Hundred and One' END AS words, CASE k % 8 WHEN 0 THEN 76630 WHEN 2 THEN 901 WHEN 4 THEN 76631 ELSE 5 END AS net, CASE k % 3 WHEN 0 THEN 1 ELSE 0 END AS id_missing,
  strftime(day, '%Y%m%d') || '120000' AS created, CASE k % 4 WHEN 0 THEN strftime(day - 1, '%Y%m%d') || '120000' WHEN 1 THEN strftime(day + 1, '%Y%m%d') || '120000' WHEN 2 THEN 'short' END AS changed FROM v_order)"""


@query(
    signal_sql(
        "v_doc",
        ("gross_minus_deductions_equals_net_pay", "kind = 'payslip'", "true", "'high'", "65"),
        ("amount_in_words_matches_net_pay", "kind = 'payslip' AND words IS NOT NULL", "doc_id % 8 IN (0, 2)", "'medium'", "40"),
        ("required_payslip_fields_present", "kind = 'payslip'", "doc_id % 2 = 1", "'medium'", "5"),
        ("editor_software_mismatch", "true", "doc_id % 5 > 1", "'medium'", "CASE WHEN kind = 'gift_letter' THEN 0 ELSE 35 END"),
        ("digital_signature_markers_present", "true", "signed", "'info'", "0"),
        ("unexpected_candidate_density", "true", "n_dates <= 5 OR kind = 'bank_statement'", "'low'", "10"),
        ("metadata_date_consistency", "length(changed) >= 14", "changed >= created", "'medium'", "30"),
    ),
    _CORE,
)
def core_signals(spark: SparkSession, d: str) -> DataFrame:
    """R51-R57, X07."""
    k = F.col("k")
    net = F.when(k % 8 == 0, 76_630).when(k % 8 == 2, 901).when(k % 8 == 4, 76_631).otherwise(5)
    base = orders(spark, d).withColumn("net", net)
    df = filing(base, "x", net_pay=F.col("net"), net_pay_in_words=pick("Seventy Six Thousand Six Hundred Thirty", "five zillion", "Nine Hundred and One", None), gross_earnings=F.col("net") + 1000, total_deductions=F.lit(1000), employee_name=F.lit("N"), employee_id=pick("", "E"))
    stamp = lambda c: F.concat(F.lit("D:"), F.date_format(c, "yyyyMMdd"), F.lit("120000+05'30'"))
    meta = F.map_filter(F.create_map(F.lit("Producer"), pick("Adobe Photoshop 2024", "made with CANVA", "Writer", None, None), F.lit("CreationDate"), stamp("day"), F.lit("ModDate"), pick(stamp(F.date_sub("day", 1)), stamp(F.date_add("day", 1)), "short", None)), lambda _, v: v.isNotNull())
    more = base.select(k.alias("doc_id"), pick("payslip", "bank_statement", "gift_letter").alias("doc_type"), meta.alias("metadata"), F.when(k % 4 == 0, F.array(F.lit("/Type/Sig"))).otherwise(F.array().cast("array<string>")).alias("signature_markers"), F.array_repeat(F.lit("1/1/2024"), (k % 9).cast("int")).alias("dates"))
    return signals(df.select("doc_id", "key_fields").join(more, "doc_id"), rules.fired(rules.core()))


_IMAGES = "v_image AS (SELECT l_orderkey // 16 AS doc_id, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1), v_metric AS (SELECT *, (q % 300) / 10.0 AS ela, (q % 20) / 10.0 AS noise, CASE q % 3 WHEN 0 THEN NULL ELSE (q % 50) * 1.0 END AS copies, (q % 90) * 1.0 AS gan FROM v_image)"


def _band(name: str, value: str, soft: str, fails: str, severity: str, score: int, mild: int) -> str:
    return f"SELECT doc_id, '{name}' AS name, CASE WHEN {fails} THEN '{severity}' WHEN {soft} THEN 'low' ELSE 'info' END AS severity, CAST(CASE WHEN {fails} THEN {score} WHEN {soft} THEN {mild} ELSE 0 END AS BIGINT) AS score, NOT ({fails}) AS passed FROM v_metric WHERE {value} IS NOT NULL"


@query(
    signal_sql(
        "v_metric",
        ("image_suspicious_authoring_tool", "true", "q % 4 > 0", "'high'", "45"),
        ("image_missing_camera_exif", "q % 5 < 3", "q % 5 = 0", "'low'", "10"),
        ("image_timestamp_inconsistency", "true", "q % 2 = 0", "'medium'", "25"),
    )
    + " UNION ALL "
    + " UNION ALL ".join([
        _band("image_ela_tampering_score", "ela", "ela >= 8", "ela >= 20", "high", 40, 15),
        _band("image_noise_inconsistency", "noise", "noise > 0.8", "noise > 1.5", "medium", 25, 10),
        _band("image_copy_move_detection", "copies", "copies > 10", "copies > 35", "high", 35, 12),
        _band("image_gan_ai_generation_score", "gan", "gan > 20", "gan > 55", "high", 30, 10),
    ]),
    _IMAGES,
)
def image_signals(spark: SparkSession, d: str) -> DataFrame:
    """R58-R64, X37, over metrics of images (orders' lines in blocks)."""
    q = F.col("q")
    rows = V.table(spark, d, "lineitem").groupBy(F.expr("l_orderkey div 16").alias("doc_id")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    exif = F.create_map(F.lit("Software"), F.when(q % 4 == 0, "Paint.NET 5").otherwise("firmware"), F.lit("EXIF DateTimeOriginal"), F.lit("2024:01:02 00:00:00"), F.lit("Image DateTime"), F.when(q % 2 == 0, "2024:01:02 00:00:01").otherwise("2024:01:01 00:00:00"))
    exif = F.when(q % 5 == 0, F.map_concat(exif, F.create_map(F.lit("Make"), F.lit("Maker")))).otherwise(exif)
    metrics = rows.select("doc_id", exif.alias("exif"), F.when(q % 5 > 2, "scan.PNG").otherwise("photo.jpg").alias("source_name"), ((q % 300) / 10.0).alias("ela_score"), ((q % 20) / 10.0).alias("noise_cv"), F.when(q % 3 != 0, (q % 50).cast("double")).alias("copy_move_score"), (q % 90).cast("double").alias("gan_score"), F.create_map().cast("map<string,string>").alias("key_fields"))
    return signals(metrics, rules.fired(rules.image()))


@query("SELECT CASE WHEN t % 7 = 0 THEN NULL WHEN t % 11 = 0 THEN 'N/A' WHEN t % 30 >= 20 THEN 'SUSPECT' WHEN t % 30 >= 8 THEN 'REVIEW' ELSE 'CLEAN' END AS ela, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s >= 75 THEN 'LOW' WHEN s >= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS pan_level, s AS pan_score, count(*) AS n FROM (SELECT t, CAST(floor(list_avg(list_filter([CASE WHEN k % 3 > 0 THEN k % 101 END, CASE WHEN k % 2 = 0 THEN 100 END, CASE WHEN k % 5 = 0 THEN 80 END], lambda x: x IS NOT NULL))) AS BIGINT) AS s FROM v_order) GROUP BY ALL", ORDERS)
def layer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """T05, T06."""
    k, t = F.col("k"), F.col("t")
    pan = rules.pan_layer(F.when(k % 3 > 0, k % 101), k % 2 == 0, k % 5 == 0)
    rows = orders(spark, d).select(rules.ela_verdict(F.when(t % 11 != 0, t % 30), t % 7 == 0).alias("ela"), pan.alias("p"))
    return rows.groupBy("ela", F.col("p.level").alias("pan_level"), F.col("p.score").cast("bigint").alias("pan_score")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, count(*) AS n, count(*) FILTER (NOT passed) AS failed FROM (" + signal_sql("v_invoice", required_sql("v_invoice", "invoice_number", "amount_due"), ("invoice_amount_arithmetic", "amount_due <> ''", "abs(subtotal + tax_amount - due) <= 2", "'high'", "50")) + ") GROUP BY 1", _INVOICE)
def error_profiles(spark: SparkSession, d: str) -> DataFrame:
    """M03, F09."""
    from docsleuth.operators import evaluate

    found = invoice_signals(spark, d).where("name <> 'gstin_format'")
    return evaluate.error_profile(found, "name", ~F.col("passed")).select("name", F.col("total").alias("n"), F.col("errors").alias("failed"))


@query("SELECT person, CAST(period AS VARCHAR) AS period, count(*) AS n_failed, CAST(sum(x) AS BIGINT) AS score FROM (SELECT person, period, unnest([gross_net, basic_within, net_arith, pf_rate, pt_slab, tds_rule, hra_prop, basic_prop, hra_basic, days_rule, basic_min]) AS x FROM v_rules) WHERE x > 0 GROUP BY ALL", f"{V.SLIPS}, {V.RULES}")
def failed_rules(spark: SparkSession, d: str) -> DataFrame:
    """failed signals of payslips' domain rules."""
    found = rules.failed(V.slips(spark, d), rules.domain_failures(types=["payslip"]))
    # grouped as the payslips are, so without another shuffle
    by_slip = found.groupBy("person", "period").agg(F.count(F.lit(1)).alias("n_failed"), F.sum("signal.score").cast("bigint").alias("score"))
    return by_slip.select("person", F.col("period").cast("string").alias("period"), "n_failed", "score")
