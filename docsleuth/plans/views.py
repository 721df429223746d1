"""Ledgers, payslip series, cases and frames derived from the driver tables, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to tasks by a fixed number, which Spark doesn't lower for its size: few bytes of rows can be much work, and a file has few row groups."""
    return df.repartition(max(96, 2 * df.sparkSession.sparkContext.defaultParallelism), *by)


def whole(c) -> F.Column:
    return F.round(c).cast("bigint")


def ledger(spark: SparkSession, d: str) -> DataFrame:
    amount = whole(F.col("value") * 1000)
    zero = F.lit(0).cast("bigint")
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("account"),
        F.col("ts").cast("date").alias("txn_date"),
        F.col("event_id").alias("txn_no"),
        kind.alias("desc"),
        F.concat(F.lit("K"), F.regexp_extract("props", r'"k": *([0-9]+)', 1)).alias("ref"),
        F.when(kind.isin("purchase", "error"), amount).otherwise(zero).alias("debit"),
        F.when(kind == "signup", amount).otherwise(zero).alias("credit"),
    )


LEDGER = """v_ledger AS (
  SELECT user_id AS account, CAST(ts AS DATE) AS txn_date, event_id AS txn_no, event_type AS descr,
         'K' || regexp_extract(props, '"k": *([0-9]+)', 1) AS ref,
         CASE WHEN event_type IN ('purchase', 'error') THEN CAST(round(value * 1000) AS BIGINT) ELSE 0 END AS debit,
         CASE WHEN event_type = 'signup' THEN CAST(round(value * 1000) AS BIGINT) ELSE 0 END AS credit
  FROM events)"""


def balances(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("account").orderBy("txn_date", "txn_no").rowsBetween(Window.unboundedPreceding, 0)
    off = F.when(F.col("txn_no") % 97 == 0, 10_000).otherwise(0)
    return ledger(spark, d).withColumn("balance", (F.sum(F.col("credit") - F.col("debit")).over(w) + 1_000_000 + off).cast("bigint"))


BALANCES = LEDGER + """, v_balance AS (
  SELECT *, CAST(sum(credit - debit) OVER (PARTITION BY account ORDER BY txn_date, txn_no ROWS UNBOUNDED PRECEDING) + 1000000
         + CASE WHEN txn_no % 97 = 0 THEN 10000 ELSE 0 END AS BIGINT) AS balance FROM v_ledger)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("person"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(whole(F.col("l_extendedprice"))).alias("gross"), F.sum(whole(F.col("l_extendedprice") * F.col("l_discount"))).alias("deductions"), F.count_if(F.col("l_returnflag") == "R").alias("lop"))
    out = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("person", "period").agg(F.sum("gross").alias("gross"), F.sum("deductions").alias("deductions"), F.sum("lop").alias("lop"), F.min("o_orderkey").alias("ord"))
    return out.withColumn("net", F.col("gross") - F.col("deductions"))


SERIES = """v_series AS (
  SELECT o_custkey AS person, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS gross,
         CAST(sum(CAST(round(l_extendedprice * l_discount) AS BIGINT)) AS BIGINT) AS deductions,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS lop, min(o_orderkey) AS ord,
         CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) - sum(CAST(round(l_extendedprice * l_discount) AS BIGINT)) AS BIGINT) AS net
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def slips(spark: SparkSession, d: str) -> DataFrame:
    """Payslips whose parts follow from fixed shares of gross."""
    m = F.month("period")
    s = series(spark, d).withColumn("basic", F.expr("gross * (15 + person % 50) div 100"))
    s = s.withColumn("m", m).withColumns({"hra": F.expr("basic * (30 + (person * 7 + m) % 60) div 100"), "pf": F.expr("basic * (8 + m % 7) div 100"), "pt": F.expr("100 + person % 150"), "tds": F.expr("CASE WHEN person % 3 = 0 THEN 0 ELSE gross div 20 END"), "days": F.expr("20 + (person + m) % 15"), "said": F.expr("net + CASE WHEN person % 11 = 0 THEN 7 ELSE 0 END")})
    fields = ["gross_earnings", "net_pay", "total_deductions", "basic", "hra", "pf", "professional_tax", "tds", "paid_days", "employee_id"]
    source = ["gross", "said", "deductions", "basic", "hra", "pf", "pt", "tds", "days", "person"]
    pairs = [x for k, v in zip(fields, source, strict=True) for x in (F.lit(k), F.col(v).cast("string"))]
    empty = F.array().cast("array<string>")
    return s.select("person", "period", F.lit("payslip").alias("doc_type"), F.create_map(*pairs).alias("key_fields"), F.create_map().cast("map<string,string>").alias("metadata"), empty.alias("signature_markers"), empty.alias("dates"), F.array().cast("array<struct<date:string,desc:string,ref:string,debit:bigint,credit:bigint,balance:bigint>>").alias("transactions"))


SLIPS = SERIES + """, v_parts AS (
  SELECT *, gross * (15 + person % 50) // 100 AS basic, month(period) AS m FROM v_series),
v_slip AS (
  SELECT person, period, gross, deductions, basic, basic * (30 + (person * 7 + m) % 60) // 100 AS hra,
         basic * (8 + m % 7) // 100 AS pf, 100 + person % 150 AS pt,
         CASE WHEN person % 3 = 0 THEN 0 ELSE gross // 20 END AS tds, 20 + (person + m) % 15 AS days,
         net + CASE WHEN person % 11 = 0 THEN 7 ELSE 0 END AS net FROM v_parts)"""


RULES = """v_rules AS (SELECT person, period,
  CASE WHEN NOT (gross >= net AND net > 0) THEN 55 ELSE 0 END AS gross_net, CASE WHEN NOT (gross >= basic AND basic > 0) THEN 40 ELSE 0 END AS basic_within,
  CASE WHEN NOT (net <= gross - pf - pt - tds + greatest(500.0, gross * 0.02)) THEN 60 ELSE 0 END AS net_arith,
  CASE WHEN basic > 0 AND pf / basic > 0.125 THEN 15 ELSE 0 END AS pf_rate, CASE WHEN pt NOT BETWEEN 0 AND 200 THEN 15 ELSE 0 END AS pt_slab,
  CASE WHEN gross * 12 > 700000 AND tds = 0 THEN 20 ELSE 0 END AS tds_rule, CASE WHEN basic > 0 AND hra / basic > 1.0 THEN 15 ELSE 0 END AS hra_prop,
  CASE WHEN gross > 0 AND NOT (basic / gross BETWEEN 0.30 AND 0.55) THEN 20 ELSE 0 END AS basic_prop,
  CASE WHEN basic > 0 AND hra / basic > 0.55 THEN CASE WHEN hra / basic * 100 - 50 > 30 THEN 50 WHEN hra / basic * 100 - 50 > 15 THEN 35 ELSE 25 END ELSE 0 END AS hra_basic,
  CASE WHEN days NOT BETWEEN 0 AND 31 THEN 15 ELSE 0 END AS days_rule, CASE WHEN gross > 0 AND basic / gross < 0.20 THEN 20 ELSE 0 END AS basic_min,
  CASE WHEN gross - deductions <> net THEN 65 ELSE 0 END AS exact, 5 AS name_missing FROM v_slip),
v_score AS (SELECT *, gross_net + basic_within + net_arith + pf_rate + pt_slab + tds_rule + hra_prop + basic_prop + hra_basic + days_rule + basic_min + exact + name_missing AS risk FROM v_rules)"""


TAXONOMY = [("licence", ["license", "licensed", "copyright"]), ("secret", ["token", "password", "secret"]), ("english", ["the ", " and "]), ("german", [" der ", " und "]), ("generic", [])]
CLASSES = "t AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents), s AS (SELECT doc_id, " + ", ".join(" + ".join(f"CASE WHEN contains(x, '{w}') THEN 1 ELSE 0 END" for w in ws) + f" AS {k}" for k, ws in TAXONOMY if ws) + " FROM t)"


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Orders as verification reports: a case for each customer."""
    score = F.expr("100 - o_orderkey * 13 % 97")
    level = F.when(score < 40, "high").when(score < 75, "medium").otherwise("low")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("payslip::BT-"), F.col("o_custkey")).alias("case_key"), F.concat(F.lit("BT-"), F.col("o_custkey")).alias("entity_ref"), F.col("o_orderpriority").alias("source_name"), F.col("o_orderstatus").alias("document_type"), level.alias("risk_level"), score.alias("truth_score"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("generated_at"))


REPORTS = """v_report AS (
  SELECT o_orderkey AS doc_id, 'payslip::BT-' || o_custkey AS case_key, 'BT-' || o_custkey AS entity_ref, o_orderpriority AS source_name,
         o_orderstatus AS document_type, CASE WHEN 100 - o_orderkey * 13 % 97 < 40 THEN 'high' WHEN 100 - o_orderkey * 13 % 97 < 75 THEN 'medium' ELSE 'low' END AS risk_level,
         100 - o_orderkey * 13 % 97 AS truth_score, strftime(o_orderdate, '%Y-%m-%d') AS day,
         strftime(o_orderdate, '%Y-%m-%d') || '#' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS generated_at FROM orders)"""


def case_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as case events, some of whose columns say nothing."""
    r = reports(spark, d)
    k = F.col("doc_id")
    return r.select("case_key", F.col("generated_at").alias("ts"), F.when(k % 3 != 0, F.col("document_type")).alias("status"), F.when(k % 4 == 0, "cleared").when(k % 7 == 0, "fraud_confirmed").when(k % 5 == 0, "open").alias("disposition"), F.when(k % 2 == 0, F.col("source_name")).alias("priority"))


CASE_EVENTS = REPORTS + """, v_event AS (
  SELECT case_key, generated_at AS ts, CASE WHEN doc_id % 3 <> 0 THEN document_type END AS status,
         CASE WHEN doc_id % 4 = 0 THEN 'cleared' WHEN doc_id % 7 = 0 THEN 'fraud_confirmed' WHEN doc_id % 5 = 0 THEN 'open' END AS disposition,
         CASE WHEN doc_id % 2 = 0 THEN source_name END AS priority FROM v_report),
v_state AS (
  SELECT case_key, arg_max(status, ts) FILTER (status IS NOT NULL) AS status, arg_max(disposition, ts) FILTER (disposition IS NOT NULL) AS disposition,
         arg_max(priority, ts) FILTER (priority IS NOT NULL) AS priority, max(ts) AS updated_at FROM v_event GROUP BY case_key)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), F.col("event_id").alias("frame_no"), (F.col("event_id") * 37 % 101 / 100).alias("nose_rel_x"), (F.col("event_id") * 53 % 89 / 100).alias("pitch"), (F.col("event_id") * 29 % 40 / 100).alias("ear"), F.lit(1.0).alias("det_score"), F.col("ts").cast("timestamp").alias("ts"))


FRAMES = """v_frame AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, event_id AS frame_no, event_id * 37 % 101 / 100.0 AS nose_rel_x,
         event_id * 53 % 89 / 100.0 AS pitch FROM events)"""


def log_rows(events: DataFrame, *more: str) -> DataFrame:
    """Events, as a table or a stream, as log records."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "DEBUG").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return events.select(*more, "ts", level.alias("level"), F.concat(F.lit("module"), (F.col("user_id") % 37).cast("string")).alias("module"), F.col("event_type").alias("msg"), whole(F.col("value") * 1000).alias("elapsed_ms"))


def logs(spark: SparkSession, d: str) -> DataFrame:
    return log_rows(table(spark, d, "events"))


LOGS = """v_log AS (
  SELECT ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
         'module' || (user_id % 37) AS module, event_type AS msg, CAST(round(value * 1000) AS BIGINT) AS elapsed_ms FROM events)"""


def income_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of applicants with one figure each: months as payslips, orders as letters, form 16 and gifts, customers as bank statements."""
    pay = series(spark, d).select(F.col("person").alias("case_id"), F.lit("payslip").alias("role"), "ord", "gross", "net", F.lit(None).cast("bigint").alias("annual"), F.lit(None).cast("bigint").alias("salary_credit"), F.concat(F.lit("ABCDE"), F.lpad((F.col("ord") % 3).cast("string"), 4, "0"), F.lit("F")).alias("pan"), F.lit("HDFC Bank").alias("bank_name"))
    total = whole(F.col("o_totalprice"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "form16").when(F.col("o_orderkey") % 3 == 1, "letter").otherwise("gift")
    other = table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), kind.alias("role"), F.col("o_orderkey").alias("ord"), F.lit(None).cast("bigint").alias("gross"), F.lit(None).cast("bigint").alias("net"), (total * 12).alias("annual"), F.lit(None).cast("bigint").alias("salary_credit"), F.concat(F.lit("ABCDE"), F.lpad((F.col("o_orderkey") % 2).cast("string"), 4, "0"), F.lit("F")).alias("pan"), F.lit(None).cast("string").alias("bank_name"))
    bank = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("bank").alias("role"), F.col("c_custkey").alias("ord"), F.lit(None).cast("bigint").alias("gross"), F.lit(None).cast("bigint").alias("net"), F.lit(None).cast("bigint").alias("annual"), whole(F.abs("c_acctbal") * 20).alias("salary_credit"), F.lit(None).cast("string").alias("pan"), F.when(F.col("c_custkey") % 2 == 0, "HDFC BANK LTD").otherwise("ICICI BANK").alias("bank_name"))
    return pay.unionByName(other).unionByName(bank)


INCOME = SERIES + """, v_income AS (
  SELECT person AS case_id, 'payslip' AS role, ord, gross, net, CAST(NULL AS BIGINT) AS annual, CAST(NULL AS BIGINT) AS salary_credit, 'ABCDE' || lpad(CAST(ord % 3 AS VARCHAR), 4, '0') || 'F' AS pan, 'HDFC Bank' AS bank_name FROM v_series
  UNION ALL SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'form16' WHEN 1 THEN 'letter' ELSE 'gift' END, o_orderkey, NULL, NULL, CAST(round(o_totalprice) AS BIGINT) * 12, NULL, 'ABCDE' || lpad(CAST(o_orderkey % 2 AS VARCHAR), 4, '0') || 'F', NULL FROM orders
  UNION ALL SELECT c_custkey, 'bank', c_custkey, NULL, NULL, NULL, CAST(round(abs(c_acctbal) * 20) AS BIGINT), NULL, CASE WHEN c_custkey % 2 = 0 THEN 'HDFC BANK LTD' ELSE 'ICICI BANK' END FROM customer),
v_evidence AS (
  SELECT case_id, CAST(floor(avg(gross) FILTER (role = 'payslip')) AS BIGINT) AS avg_gross, CAST(floor(avg(net) FILTER (role = 'payslip')) AS BIGINT) AS avg_net,
         arg_min(annual, ord) FILTER (role = 'letter') AS annual_ctc, arg_min(annual, ord) FILTER (role = 'form16') AS form16_gross,
         CAST(floor(avg(salary_credit) FILTER (role = 'bank')) AS BIGINT) AS avg_salary_credit,
         arg_min(pan, ord) FILTER (role = 'payslip') AS payslip_pan, arg_min(pan, ord) FILTER (role = 'form16') AS form16_pan,
         arg_min(bank_name, ord) FILTER (role = 'bank') AS statement_bank
  FROM v_income GROUP BY case_id)"""
