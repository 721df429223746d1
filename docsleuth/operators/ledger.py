"""Bank ledgers: round trips, repeated references, salary months, date coverage, running balances.

Two forms of each operator: over a table of ledger rows, for whole corpora, and over one statement's array, for
rules. Table forms name their columns as parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsleuth.functions import fixed
from docsleuth.functions import scalars as X
from docsleuth.operators import segments

TRANSACTION = "struct<date:string,desc:string,ref:string,debit:bigint,credit:bigint,balance:bigint>"
TRANSACTIONS = f"array<{TRANSACTION}>"
MIN_AMOUNT = 100_000
BAND_PERCENT = 2


def is_salary(desc: Column) -> Column:
    return F.lower(desc).rlike("|".join(fixed.SALARY_WORDS))


def round_trips(rows: DataFrame, account: str = "account", date: str = "txn_date", order: str = "txn_no", debit: str = "debit", credit: str = "credit", minimum: int = MIN_AMOUNT) -> DataFrame:
    """Pairs of a large debit and a credit of nearly the same amount, of one account and day.

    Both sides are filtered before the join, whose key is account and day; the two per cent band is its residual.
    """
    out = rows.where(F.col(debit) >= minimum).select(F.col(account).alias("account"), F.col(date).alias("txn_date"), F.col(order).alias("debit_txn"), F.col(debit).alias("debit"))
    back = rows.where(F.col(credit) >= minimum).select(F.col(account).alias("account"), F.col(date).alias("txn_date"), F.col(order).alias("credit_txn"), F.col(credit).alias("credit"))
    delta = F.abs(F.col("debit") - F.col("credit"))
    return out.join(back, ["account", "txn_date"]).where(delta * 100 <= F.greatest(F.col("debit"), F.lit(1)) * BAND_PERCENT).withColumn("delta", delta)


def repeated_references(rows: DataFrame, account: str = "account", ref: str = "ref", order: str = "txn_no") -> DataFrame:
    """Every use of a reference but the first."""
    nth = F.row_number().over(Window.partitionBy(account, ref).orderBy(order))
    return rows.where(F.trim(F.col(ref)) != "").withColumn("use", nth).where("use > 1")


def repeated_salary(rows: DataFrame, account: str = "account", date: str = "txn_date", order: str = "txn_no", salary: Column | None = None) -> DataFrame:
    """Every salary credit of a month but the first."""
    found = rows.where(is_salary(F.col("desc")) if salary is None else salary).withColumn("month", F.date_format(date, "yyyy-MM"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(account, "month").orderBy(order))).where("nth > 1")


def coverage(rows: DataFrame, account: str = "account", date: str = "txn_date") -> DataFrame:
    """First and last day, totals and the span in days and thirty-day months."""
    found = rows.groupBy(F.col(account).alias("account")).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.sum("debit").alias("debit_total"), F.sum("credit").alias("credit_total"), F.count(F.lit(1)).alias("n_txns"))
    days = F.date_diff("last_date", "first_date")
    return found.withColumn("span_days", days).withColumn("span_months", F.round(days / 30, 1))


def balance_errors(rows: DataFrame, account: str = "account", date: str = "txn_date", order: str = "txn_no", balance: str = "balance") -> DataFrame:
    """Rows whose stated balance does not follow from the one before; large round differences are marked."""
    w = Window.partitionBy(account).orderBy(F.col(date).asc_nulls_first(), order)
    expected = F.lag(balance).over(w) + F.col("credit") - F.col("debit")
    return _balance_errors(rows.withColumn("expected", expected), balance)


def _balance_errors(rows: DataFrame, balance: str) -> DataFrame:
    found = rows.withColumn("diff", F.abs(F.col(balance) - F.col("expected")))
    found = found.where(F.col("diff") > F.greatest(F.lit(500).cast("bigint"), (F.abs(F.col("expected")) * 0.01).cast("bigint")))
    return found.withColumn("round_number", (F.col("diff") >= 10_000) & (F.col("diff") % 1000 == 0))


def balance_errors_in_ranges(rows: DataFrame, account: str = "account", date: str = "txn_date", order: str = "txn_no", balance: str = "balance", ranges: int | None = None) -> DataFrame:
    """W02 for accounts of any size: as balance_errors(), but no task holds an account whole."""
    found = segments.with_previous(rows, account, [date, order], [balance], ranges)
    expected = F.col("previous")[balance] + F.col("credit") - F.col("debit")
    return _balance_errors(found.withColumn("expected", expected).drop("previous"), balance)


def first_balance_errors(rows: DataFrame, account: str = "account", **columns: str) -> DataFrame:
    """R42 over a table: the first error of each account, by date and number, decides."""
    at = F.struct(columns.get("date", "txn_date"), columns.get("order", "txn_no"))
    return balance_errors(rows, account, **columns).groupBy(F.col(account).alias("account")).agg(F.count(F.lit(1)).alias("n_errors"), F.min_by(F.struct("diff", "round_number"), at).alias("first")).select("account", "n_errors", F.col("first.diff").alias("first_diff"), F.col("first.round_number").alias("suspicious"))


FINDINGS = "struct<n_rows:bigint,has_references:boolean,has_salary:boolean,pairs:bigint,evidence:string,repeated_references:bigint,references:string,repeated_months:bigint,months:string,error_row:bigint,error_diff:bigint>"


def findings_of(t: Column) -> Column:
    """What rules ask of a statement's ledger, from its array: for statements whose rows came with a document."""
    pairs, refs, months, error = round_trip_array(t), repeated_reference_array(t), repeated_salary_array(t), first_balance_error_array(t)
    return F.struct(
        F.coalesce(F.size(t), F.lit(0)).alias("n_rows"), F.exists(t, lambda x: F.trim(x["ref"]) != "").alias("has_references"), F.exists(t, lambda x: is_salary(x["desc"])).alias("has_salary"),
        F.size(pairs).alias("pairs"), F.to_json(F.slice(pairs, 1, 5)).alias("evidence"), F.size(refs).alias("repeated_references"), F.array_join(F.slice(refs, 1, 10), ",").alias("references"),
        F.size(months).alias("repeated_months"), F.array_join(months, ",").alias("months"), error["txn_no"].alias("error_row"), error["diff"].alias("error_diff"),
    ).cast(FINDINGS)


def findings(rows: DataFrame, account: str = "account", date: str = "txn_date", order: str = "txn_no", ranges: int | None = None) -> DataFrame:
    """account, ledger_findings: the same from a table of ledger rows, for ledgers of any size; no account's rows are gathered.

    Each figure is an aggregation or a join on account and day, reference or month. Evidence and the lists of references and months are not kept; the
    error's row is its number in the table.
    """
    key = F.col(account).alias("account")
    count = F.count(F.lit(1)).cast("bigint")
    salary = is_salary(F.col("desc"))
    whole = rows.groupBy(key).agg(count.alias("n_rows"), F.bool_or(F.trim("ref") != "").alias("has_references"), F.bool_or(salary).alias("has_salary"))
    trips = round_trips(rows, account, date, order).groupBy("account").agg(count.alias("pairs"))
    # all uses of a reference, and all salaries of a month, but the first
    refs = rows.where(F.trim("ref") != "").groupBy(key, F.trim("ref").alias("r")).agg(count.alias("n")).where("n > 1").groupBy("account").agg(F.sum(F.col("n") - 1).alias("repeated_references"))
    months = rows.where(salary).groupBy(key, F.date_format(date, "yyyy-MM").alias("m")).agg(count.alias("n")).where("n > 1").groupBy("account").agg(F.sum(F.col("n") - 1).alias("repeated_months"))
    at = F.struct(F.col(date), F.col(order))
    errors = balance_errors_in_ranges(rows, account, date, order, ranges=ranges).groupBy(key).agg(F.min_by(F.struct(F.col(order).cast("bigint").alias("error_row"), F.col("diff").alias("error_diff")), at).alias("e")).select("account", "e.*")
    out = whole
    for part in (trips, refs, months, errors):
        out = out.join(part, "account", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("pairs", "repeated_references", "repeated_months")}
    named = {n: zero.get(n, F.lit(None) if n in ("evidence", "references", "months") else F.col(n)) for n in (f.split(":")[0] for f in FINDINGS[7:-1].split(","))}
    return out.select("account", F.struct(*[c.alias(n) for n, c in named.items()]).cast(FINDINGS).alias("ledger_findings"))


def features(rows: DataFrame, account: str = "account", date: str = "txn_date") -> DataFrame:
    """Rows a month, largest and mean balance, days since the last salary credit."""
    months = F.count_distinct(F.date_format(date, "yyyy-MM"))
    found = rows.groupBy(F.col(account).alias("account")).agg(F.count(F.lit(1)).alias("n_txns"), months.alias("n_months"), F.max("balance").alias("max_balance"), F.sum("balance").alias("sum_balance"), F.date_diff(F.max(date), F.max(F.when(is_salary(F.col("desc")), F.col(date)))).alias("days_since_salary"))
    return found.withColumn("avg_balance", F.expr("sum_balance div n_txns")).drop("sum_balance")


def salary_spikes(rows: DataFrame, account: str = "account", date: str = "txn_date", salary: Column | None = None) -> DataFrame:
    """Months whose salary credit is over twice the account's median month."""
    found = rows.where(is_salary(F.col("desc")) if salary is None else salary).groupBy(F.col(account).alias("account"), F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum("credit").alias("credit"))
    return found.withColumn("median", F.expr("percentile(credit, 0.5)").over(Window.partitionBy("account"))).where("credit > 2 * median")


def round_trip_array(t: Column, minimum: int = MIN_AMOUNT) -> Column:
    """J01 within one statement."""
    large = lambda side: F.filter(t, lambda x: x[side] >= minimum)
    hits = F.transform(large("debit"), lambda d: F.transform(F.filter(large("credit"), lambda c: (c["date"] == d["date"]) & (F.abs(d["debit"] - c["credit"]) * 100 <= F.greatest(d["debit"], F.lit(1)) * BAND_PERCENT)), lambda c: F.struct(d["date"].alias("date"), d["debit"].alias("debit"), c["credit"].alias("credit"), F.round(F.abs(d["debit"] - c["credit"]) * 100 / F.greatest(d["debit"], F.lit(1)), 2).alias("delta_pct"))))
    return F.flatten(hits)


def repeated_reference_array(t: Column) -> Column:
    return _again(F.filter(F.transform(t, lambda x: F.trim(x["ref"])), lambda r: r != ""))


def repeated_salary_array(t: Column) -> Column:
    return _again(F.transform(F.filter(t, lambda x: is_salary(x["desc"])), lambda x: F.date_format(X.bank_date(x["date"]), "yyyy-MM")))


def _again(values: Column) -> Column:
    """Every use of a value but the first, in order; nulls are none. Values are sorted by value and place, so the work grows with n log n."""
    placed = F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    # an array of one element binds what the lambda looks back at, which would else be evaluated for each value
    again = F.get(F.transform(F.array(placed), lambda s: F.filter(s, lambda x, j: F.get(s, j - 1)["v"] == x["v"])), 0)
    return F.transform(F.sort_array(F.transform(again, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])


def first_balance_error_array(t: Column) -> Column:
    """W02 within one statement: (txn_no, diff) of the first error, or null."""
    keyed = F.transform(t, lambda x, i: F.struct(F.coalesce(X.bank_date(x["date"]), F.lit("0001-01-01").cast("date")).alias("d"), i.alias("i"), x["debit"].alias("debit"), x["credit"].alias("credit"), x["balance"].alias("balance")))
    ordered = F.array_sort(keyed)
    zero = F.lit(0).cast("bigint")
    # let-binding by a one-element array keeps the sort out of the inner loop
    errors = F.transform(F.array(ordered), lambda s: F.filter(F.transform(s, lambda x, i: F.struct((i + 1).alias("txn_no"), F.abs(x["balance"] - (F.get(s, i - 1)["balance"] + F.coalesce(x["credit"], zero) - F.coalesce(x["debit"], zero))).alias("diff"), F.abs(F.get(s, i - 1)["balance"] + F.coalesce(x["credit"], zero) - F.coalesce(x["debit"], zero)).alias("expected"))), lambda e: e["diff"] > F.greatest(F.lit(500).cast("bigint"), (e["expected"] * 0.01).cast("bigint"))))
    return F.get(F.get(errors, 0), 0)
