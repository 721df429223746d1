"""Income reconciliation across an applicant's documents: one conditional aggregation, then checks as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsleuth.functions import scalars as X

TOLERANCE = 0.15
STOP_WORDS = ["BANK", "LTD", "LIMITED", "FINANCIAL", "OF", "INDIA"]


def role(doc_type: Column, key_fields: Column, named: Column) -> Column:
    """What a summary tells of: payslip, letter, form16, bank, gift or null. Generic ones count as letter or form 16 by tell-tale fields or titles."""
    filled = lambda k: X.blank_to_null(key_fields[k]).isNotNull()
    title = F.lower(F.coalesce(key_fields["title"], F.lit("")))
    has = lambda k: F.coalesce(F.map_contains_key(named, F.lit(k)), F.lit(False))
    generic = doc_type == "generic"
    letter = filled("annual_ctc") | filled("gross_monthly_salary") | has("annual_ctc") | has("gross_monthly_salary") | title.contains("whomsoever")
    form16 = title.rlike("form 16|form-16|certificate of tax") | has("assessment_year") | has("gross_salary_total") | has("tan_of_employer")
    return F.when(doc_type == "payslip", "payslip").when((doc_type == "employment_letter") | generic & letter, "letter").when((doc_type == "form16") | generic & form16, "form16").when(doc_type == "bank_statement", "bank").when(doc_type == "gift_letter", "gift")


def routed(summaries: DataFrame, key: str = "case_id", order: str = "ord") -> DataFrame:
    """Summaries (doc_type, key_fields, named_fields, transactions) as the rows that evidence() takes, one a document; a bank statement's salary credit is the mean of its salary rows."""
    k, n = F.col("key_fields"), F.transform_values("named_fields", lambda _, v: F.get(v, 0))
    one = lambda *vs: amount(X.first_filled(*vs))
    who = role(F.col("doc_type"), k, F.col("named_fields"))
    at = lambda r, v: F.when(who == r, F.nullif(v, F.lit(0).cast("bigint")))
    salary = F.filter("transactions", lambda t: F.lower(t["desc"]).contains("salary credit") & t["credit"].between(5_000, 2_000_000))
    mean = F.try_divide(F.aggregate(salary, F.lit(0).cast("bigint"), lambda a, t: a + t["credit"]), F.size(salary)).cast("bigint")
    annual = F.coalesce(at("letter", one(k["annual_ctc"], k["ctc"], n["annual_ctc"], n["ctc"])), at("form16", one(k["gross_salary"], k["gross_earnings"], n["gross_salary_total"], n["gross_salary"], n["gross_earnings"])), at("gift", one(k["gift_amount"])))
    pan = F.when(who == "payslip", k["pan"]).when(who == "form16", n["pan_of_employee"])
    bank = F.when(who == "payslip", k["bank"]).when(who == "bank", k["bank_name"])
    return summaries.select(
        key,
        who.alias("role"),
        order,
        at("payslip", one(k["gross_earnings"])).alias("gross"),
        at("payslip", one(k["net_pay"])).alias("net"),
        annual.alias("annual"),
        at("bank", mean).alias("salary_credit"),
        X.blank_to_null(F.upper(F.trim(pan))).alias("pan"),
        X.blank_to_null(F.upper(F.trim(bank))).alias("bank_name"),
    ).where("role is not null")


def sources(docs: DataFrame, key: str = "case_id", order: str = "ord") -> DataFrame:
    """The evidence behind the figures, a row for each document's income: monthly and times twelve."""
    monthly = F.when(F.col("role") == "payslip", F.col("gross")).when(F.col("role") == "bank", F.col("salary_credit")).otherwise((F.col("annual") / 12).cast("bigint"))
    return docs.where(F.col("role") != "gift").select(key, "role", order, monthly.alias("monthly"), F.when(F.col("role").isin("letter", "form16"), F.col("annual")).otherwise(monthly * 12).alias("yearly")).where("monthly is not null")


def evidence(docs: DataFrame, key: str = "case_id", order: str = "ord") -> DataFrame:
    """Figures of each case. docs: role (payslip, letter, form16, bank, gift) and one amount or text column for each figure."""
    def first(c: str, role: str) -> Column:
        return F.min_by(c, F.when((F.col("role") == role) & F.col(c).isNotNull(), F.col(order)))

    def mean(c: str, role: str) -> Column:
        hit = F.when(F.col("role") == role, F.col(c))
        return F.floor(F.try_divide(F.sum(hit), F.count(hit))).cast("bigint")

    return docs.groupBy(key).agg(
        F.count_if(F.col("role") == "payslip").alias("n_payslips"),
        mean("gross", "payslip").alias("avg_gross"),
        mean("net", "payslip").alias("avg_net"),
        first("annual", "letter").alias("annual_ctc"),
        first("annual", "form16").alias("form16_gross"),
        mean("salary_credit", "bank").alias("avg_salary_credit"),
        first("pan", "payslip").alias("payslip_pan"),
        first("pan", "form16").alias("form16_pan"),
        first("bank_name", "payslip").alias("payslip_bank"),
        first("bank_name", "bank").alias("statement_bank"),
        first("annual", "gift").alias("gift_amount"),
    )


def bank_words(v: Column) -> Column:
    return F.filter(F.split(F.upper(v), "[^A-Z]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def same_bank(a: Column, b: Column) -> Column:
    """J09."""
    return F.exists(bank_words(a), lambda w: F.contains(F.upper(b), w))


def checks(found: DataFrame, key: str = "case_id") -> DataFrame:
    """One row for each figure that does not agree; a case without payslips has none."""
    off = lambda a, b: F.try_divide(F.abs(a - b), F.greatest(b, F.lit(1))) > TOLERANCE
    c, yearly = F.col, F.col("avg_gross") * 12
    rows = [
        ("payslip_vs_form16_salary_mismatch", "high", off(yearly, c("form16_gross")), F.abs(yearly - c("form16_gross"))),
        ("payslip_vs_offer_letter_salary_mismatch", "high", off(yearly, c("annual_ctc")), F.abs(yearly - c("annual_ctc"))),
        ("offer_letter_vs_form16_salary_mismatch", "medium", off(c("annual_ctc"), c("form16_gross")), F.abs(c("annual_ctc") - c("form16_gross"))),
        ("payslip_net_vs_bank_salary_credit_mismatch", "high", off(c("avg_net"), c("avg_salary_credit")), F.abs(c("avg_net") - c("avg_salary_credit"))),
        ("pan_mismatch_payslip_vs_form16", "high", F.upper("payslip_pan") != F.upper("form16_pan"), F.lit(None)),
        ("bank_name_payslip_vs_statement_mismatch", "high", ~same_bank(c("payslip_bank"), c("statement_bank")), F.lit(None)),
    ]
    made = F.array_compact(F.array(*[F.when(fails, F.struct(F.lit(n).alias("type"), F.lit(s).alias("severity"), d.cast("bigint").alias("delta"))) for n, s, fails, d in rows]))
    return found.where(F.col("avg_gross") > 0).select(key, F.explode(made).alias("a")).select(key, "a.*")


def gift_matches(found: DataFrame, ledger: DataFrame, key: str = "case_id", order: str = "txn_no", evidence: int = 3) -> DataFrame:
    """Ledger amounts over 10 000 within two per cent of the gift; the first few as evidence."""
    amounts = ledger.select(key, order, F.explode(F.array("debit", "credit")).alias("amount")).where("amount > 10000")
    hit = amounts.join(found.where("gift_amount > 0").select(key, "gift_amount"), key).where(F.abs(F.col("amount") - F.col("gift_amount")) * 100 <= F.col("gift_amount") * 2)
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("n_matches"), F.slice(F.array_sort(F.collect_list(F.struct(order, "amount"))), 1, evidence).alias("matches"))


def multipliers(anomalies: DataFrame, key: str = "case_id") -> DataFrame:
    """Points that findings across documents add to a case's risk."""
    points = F.when(F.col("type").contains("pan_mismatch"), 30).when(F.col("type").contains("form16"), 20).otherwise(15)
    return anomalies.groupBy(key).agg(F.sum(points).alias("cross_document_points"))


def joined_after_payslip(first_payslip: Column, join_date: Column) -> Column:
    """N10."""
    return join_date > first_payslip


def free_mail(email: Column) -> Column:
    """N11."""
    return F.lower(email).rlike("@(gmail|yahoo|outlook|hotmail|rediffmail|proton|icloud)\\.")


def amount(v: Column) -> Column:
    return X.parse_amount(v)
