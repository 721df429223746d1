"""The queries, each a thin application of an operator, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsleuth.functions import scalars as X
from docsleuth.operators import blocks, cases, clusters, entities, evaluate, extract, identity, ledger, reconcile, reports, rules, series
from docsleuth.plans import arrivals, desk, filings, papers, pruned  # noqa: F401  (they register their queries)
from docsleuth.plans import views as V
from docsleuth.plans.registry import QUERIES, SQL, Query, longs, query
from docsleuth.sources.shared import one_by_one, shared_dir, written
from docsleuth.streaming import flows, kyc



def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ledgers

_PAIRS = """v_pair AS (SELECT a.account, a.txn_date, a.txn_no AS debit_txn, b.txn_no AS credit_txn, a.debit, b.credit, abs(a.debit - b.credit) AS delta
  FROM v_ledger a JOIN v_ledger b ON a.account = b.account AND a.txn_date = b.txn_date
  WHERE a.debit >= 20000 AND b.credit >= 20000 AND abs(a.debit - b.credit) * 100 <= greatest(a.debit, 1) * 2)"""


@query("SELECT account, CAST(txn_date AS VARCHAR) AS day, debit_txn, credit_txn, debit, credit, delta FROM v_pair", f"{V.LEDGER}, {_PAIRS}")
def round_trip_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.round_trips(V.ledger(spark, d), minimum=20_000)
    return found.select("account", F.col("txn_date").cast("string").alias("day"), "debit_txn", "credit_txn", "debit", "credit", "delta")


@query(
    """SELECT l.account, l.n_txns, l.debit_total, l.credit_total, coalesce(r.n, 0) AS repeated_refs, coalesce(p.n, 0) AS round_trips,
  CASE WHEN 40 * least(coalesce(p.n, 0), 1) + 35 * least(coalesce(r.n, 0), 1) >= 60 THEN 'high' WHEN 40 * least(coalesce(p.n, 0), 1) + 35 * least(coalesce(r.n, 0), 1) >= 25 THEN 'medium' ELSE 'low' END AS risk_level
  FROM (SELECT account, count(*) AS n_txns, CAST(sum(debit) AS BIGINT) AS debit_total, CAST(sum(credit) AS BIGINT) AS credit_total FROM v_ledger GROUP BY 1) l
  LEFT JOIN (SELECT account, CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT account, ref, count(*) AS c FROM v_ledger GROUP BY 1, 2) GROUP BY 1) r ON l.account = r.account
  LEFT JOIN (SELECT account, count(*) AS n FROM v_pair GROUP BY 1) p ON l.account = p.account""",
    f"{V.LEDGER}, {_PAIRS}",
)
def ledger_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ledger(spark, d)
    totals = ledger.coverage(rows).select("account", "n_txns", "debit_total", "credit_total")
    # repeats need counts alone, which combine before the shuffle
    refs = rows.groupBy("account", "ref").agg(F.count(F.lit(1)).alias("c")).groupBy("account").agg(F.sum(F.col("c") - 1).alias("r"))
    pairs = ledger.round_trips(rows, minimum=20_000).groupBy("account").agg(F.count(F.lit(1)).alias("p"))
    out = totals.join(refs, "account", "left").join(pairs, "account", "left").fillna(0, ["r", "p"])
    risk = 40 * F.least(F.col("p"), F.lit(1)) + 35 * F.least(F.col("r"), F.lit(1))
    level = F.when(risk >= 60, "high").when(risk >= 25, "medium").otherwise("low")
    return out.select("account", "n_txns", "debit_total", "credit_total", F.col("r").alias("repeated_refs"), F.col("p").alias("round_trips"), level.alias("risk_level"))


@query("SELECT account, ref, txn_no, CAST(row_number() OVER (PARTITION BY account, ref ORDER BY txn_no) AS BIGINT) AS use FROM v_ledger WHERE trim(ref) <> '' QUALIFY row_number() OVER (PARTITION BY account, ref ORDER BY txn_no) > 1", V.LEDGER)
def duplicate_references(spark: SparkSession, d: str) -> DataFrame:
    return ledger.repeated_references(V.ledger(spark, d)).select("account", "ref", "txn_no", *longs("use"))


@query("SELECT account, strftime(txn_date, '%Y-%m') AS month, txn_no, credit FROM v_ledger WHERE descr = 'signup' QUALIFY row_number() OVER (PARTITION BY account, strftime(txn_date, '%Y-%m') ORDER BY txn_no) > 1", V.LEDGER)
def salary_regularity(spark: SparkSession, d: str) -> DataFrame:
    return ledger.repeated_salary(V.ledger(spark, d), salary=F.col("desc") == "signup").select("account", "month", "txn_no", "credit")


@query("SELECT account, CAST(min(txn_date) AS VARCHAR) AS first_day, CAST(max(txn_date) AS VARCHAR) AS last_day, CAST(date_diff('day', min(txn_date), max(txn_date)) AS BIGINT) AS span_days, CAST(sum(debit) AS BIGINT) AS debit_total, CAST(sum(credit) AS BIGINT) AS credit_total FROM v_ledger GROUP BY account", V.LEDGER)
def date_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ledger.coverage(V.ledger(spark, d)).select("account", F.col("first_date").cast("string").alias("first_day"), F.col("last_date").cast("string").alias("last_day"), *longs("span_days"), "debit_total", "credit_total")


_ERRORS = """v_error AS (SELECT account, txn_date, txn_no, expected, abs(balance - expected) AS diff FROM (
  SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY txn_date, txn_no) + credit - debit AS expected FROM v_balance)
  WHERE abs(balance - expected) > greatest(500, CAST(trunc(abs(expected) * 0.01) AS BIGINT)))"""


@query("SELECT account, txn_no, expected, diff, diff >= 10000 AND diff % 1000 = 0 AS round_number FROM v_error", f"{V.BALANCES}, {_ERRORS}")
def running_balance_errors(spark: SparkSession, d: str) -> DataFrame:
    return ledger.balance_errors(V.balances(spark, d)).select("account", "txn_no", "expected", "diff", "round_number")


@query("SELECT account, count(*) AS n_errors, arg_min(diff, [CAST(txn_date - DATE '1970-01-01' AS BIGINT), txn_no]) AS first_diff, arg_min(diff >= 10000 AND diff % 1000 = 0, [CAST(txn_date - DATE '1970-01-01' AS BIGINT), txn_no]) AS suspicious FROM v_error GROUP BY account", f"{V.BALANCES}, {_ERRORS}")
def first_balance_errors(spark: SparkSession, d: str) -> DataFrame:
    return ledger.first_balance_errors(V.balances(spark, d))


@query("SELECT account, count(*) AS n_txns, count(DISTINCT strftime(txn_date, '%Y-%m')) AS n_months, max(balance) AS max_balance, CAST(trunc(sum(balance) / count(*)) AS BIGINT) AS avg_balance FROM v_balance GROUP BY account", V.BALANCES)
def ledger_features(spark: SparkSession, d: str) -> DataFrame:
    return ledger.features(V.balances(spark, d)).select("account", "n_txns", "n_months", "max_balance", "avg_balance")


@query("SELECT account, month, credit FROM (SELECT account, strftime(txn_date, '%Y-%m') AS month, CAST(sum(credit) AS BIGINT) AS credit FROM v_ledger WHERE descr = 'signup' GROUP BY 1, 2) QUALIFY credit > 2 * median(credit) OVER (PARTITION BY account)", V.LEDGER)
def salary_spikes(spark: SparkSession, d: str) -> DataFrame:
    return ledger.salary_spikes(V.ledger(spark, d), salary=F.col("desc") == "signup").select("account", "month", "credit")


# payslip series

_DELTA = """v_delta AS (SELECT *, lag(gross) OVER w AS pg, lag(net) OVER w AS pn, lag(deductions) OVER w AS pd, lag(lop) OVER w AS pl, lag(period) OVER w AS pp, row_number() OVER w AS nth
  FROM v_series WINDOW w AS (PARTITION BY person ORDER BY period, ord))"""
_ANOMALY = """v_anomaly AS (
  SELECT person, pp, period, 'gross_earnings_variance' AS type, 'medium' AS severity, abs(gross - pg) AS amount FROM v_delta WHERE gross <> 0 AND pg <> 0 AND abs(gross - pg) * 4 >= greatest(pg, 1)
  UNION ALL SELECT person, pp, period, 'deduction_spike', 'medium', deductions - pd FROM v_delta WHERE deductions > greatest(pd * 1.5, pd + 5000) AND pd IS NOT NULL
  UNION ALL SELECT person, pp, period, 'lop_days_increase', 'low', lop FROM v_delta WHERE lop > 0 AND coalesce(pl, 0) = 0 AND nth > 1
  UNION ALL SELECT person, pp, period, 'net_pay_drop_spike', CASE WHEN (pn - net) * 100 >= 50 * pn THEN 'high' ELSE 'medium' END, pn - net FROM v_delta WHERE pn > 0 AND net < pn AND (pn - net) * 100 >= 30 * pn
  UNION ALL SELECT person, pp, period, 'period_gap', 'medium', date_diff('month', pp, period) - 1 FROM v_delta WHERE date_diff('month', pp, period) > 1)"""


@query("SELECT person, CAST(period AS VARCHAR) AS period, CAST(pp AS VARCHAR) AS prev_period, gross - pg AS gross_change, net - pn AS net_change, deductions - pd AS deductions_change, lop - pl AS lop_change FROM v_delta", f"{V.SERIES}, {_DELTA}")
def payslip_deltas(spark: SparkSession, d: str) -> DataFrame:
    return series.deltas(V.series(spark, d)).select("person", F.col("period").cast("string").alias("period"), F.col("prev_period").cast("string").alias("prev_period"), "gross_change", "net_change", "deductions_change", "lop_change")


@query("SELECT person, type, severity, CAST(pp AS VARCHAR) AS from_period, CAST(period AS VARCHAR) AS to_period, CAST(amount AS BIGINT) AS amount FROM v_anomaly", f"{V.SERIES}, {_DELTA}, {_ANOMALY}")
def payslip_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return series.anomalies(V.series(spark, d)).select("person", "type", "severity", F.col("from_period").cast("string").alias("from_period"), F.col("to_period").cast("string").alias("to_period"), "amount")


@query("SELECT s.person, count(*) AS n_payslips, count(*) - 1 AS n_comparisons, coalesce(any_value(a.n), 0) AS n_anomalies FROM v_series s LEFT JOIN (SELECT person, count(*) AS n FROM v_anomaly GROUP BY 1) a ON s.person = a.person GROUP BY s.person", f"{V.SERIES}, {_DELTA}, {_ANOMALY}")
def payslip_series_summary(spark: SparkSession, d: str) -> DataFrame:
    return series.summary(V.series(spark, d))


@query("""SELECT o_custkey AS person, 'status_drift' AS type, 'high' AS severity, string_agg(o_orderstatus, ', ' ORDER BY first) AS "values" FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1""")
def identity_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("person"), "o_orderstatus", F.col("o_orderkey").alias("ord"), F.col("o_orderdate").cast("date").alias("period"))
    return series.drift(rows, "o_orderstatus", "status_drift", "high").select("person", "type", "severity", "values")


# rules and scores

@query("SELECT person, CAST(period AS VARCHAR) AS period, CAST(risk AS BIGINT) AS risk_score, CAST(greatest(0, 100 - risk) AS BIGINT) AS truth_score, CASE WHEN risk >= 60 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS risk_level FROM v_score", f"{V.SLIPS}, {V.RULES}")
def payslip_scores(spark: SparkSession, d: str) -> DataFrame:
    return rules.assess(V.slips(spark, d), types=["payslip"], with_signals=False).select("person", F.col("period").cast("string").alias("period"), *longs("risk_score", "truth_score"), "risk_level")


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'domain::{n}' AS name, count_if({c} > 0) AS failed, CAST(sum({c}) AS BIGINT) AS total_score FROM v_rules" for n, c in [("gross_gte_net_pay", "gross_net"), ("basic_within_gross", "basic_within"), ("net_pay_arithmetic", "net_arith"), ("pf_rate_validity", "pf_rate"), ("pt_slab_validity", "pt_slab"), ("tds_plausibility", "tds_rule"), ("hra_proportion", "hra_prop"), ("basic_gross_proportion", "basic_prop"), ("hra_basic_proportion", "hra_basic"), ("paid_days_range", "days_rule"), ("basic_minimum_proportion", "basic_min")]) + ") WHERE failed > 0",
    f"{V.SLIPS}, {V.RULES}",
)
def rule_failures(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_rollup(rules.assess(V.slips(spark, d), types=["payslip"])).where("failed > 0 and name like 'domain::%'").select("name", "failed", *longs("total_score"))


# documents

@query("SELECT doc_id, CASE WHEN greatest(licence, secret, english, german) = 0 THEN 'generic' WHEN licence = greatest(licence, secret, english, german) THEN 'licence' WHEN secret = greatest(secret, english, german) THEN 'secret' WHEN english >= german THEN 'english' ELSE 'german' END AS doc_type, CAST(greatest(licence, secret, english, german) AS BIGINT) AS score FROM s", V.CLASSES)
def classified_documents(spark: SparkSession, d: str) -> DataFrame:
    found = V.table(spark, d, "documents").withColumn("c", extract.classify(F.lit(""), F.col("text"), V.TAXONOMY))
    return found.select("doc_id", F.col("c.type").alias("doc_type"), F.coalesce(F.col("c.scores")[F.col("c.type")], F.lit(0)).cast("bigint").alias("score"))


@query("SELECT doc_id, count(*) AS n_lines, CAST(sum(length(trim(x))) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> '' GROUP BY doc_id")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = extract.lines(V.table(spark, d, "documents").withColumn("pages", F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")))))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(r"SELECT doc_id, CAST((CASE WHEN regexp_matches(text, '\S') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '[A-Za-z]{3,}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '\b[A-Z]{5}[0-9]{4}[A-Z]\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b') THEN 2 ELSE 0 END) AS BIGINT) AS tenths FROM documents")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.round(X.text_quality(F.col("text")) * 10).cast("bigint").alias("tenths"))


@query("SELECT c_custkey, TRY_CAST(nullif(regexp_replace(c_name, '[^0-9-]', '', 'g'), '') AS BIGINT) AS amount, trim(regexp_replace(lower(trim(c_name || ' (' || c_mktsegment || ')')), '[^a-z0-9]+', '_', 'g'), '_') AS label FROM customer")
def parsed_labels(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")"))
    return V.table(spark, d, "customer").select("c_custkey", X.parse_amount(F.col("c_name")).alias("amount"), X.normalize_label(full).alias("label"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'license')")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return cases.containing(V.table(spark, d, "documents"), "license", "text").select("doc_id", "source", "n_chars")


# cases, entities, dashboards

@query("SELECT case_key, max(CASE risk_level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)::BIGINT AS risk_rank, least(100, min(truth_score))::BIGINT AS min_truth_score, max(generated_at) AS latest, count(*) AS n_documents, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY generated_at DESC) AS documents FROM v_report GROUP BY case_key", V.REPORTS)
def case_groups(spark: SparkSession, d: str) -> DataFrame:
    found = cases.grouped(V.reports(spark, d))
    return found.select("case_key", *longs("risk_rank", "min_truth_score"), "latest", "n_documents", F.array_join(F.transform("documents", lambda x: x["doc_id"].cast("string")), ",").alias("documents"))


@query("SELECT case_key, status, disposition, priority, updated_at FROM v_state", V.CASE_EVENTS)
def case_states(spark: SparkSession, d: str) -> DataFrame:
    return cases.folded(V.case_events(spark, d), columns=["status", "disposition", "priority"])


_QUEUE = """v_case AS (SELECT case_key, max(CASE risk_level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS risk_rank, max(generated_at) AS latest FROM v_report GROUP BY 1),
v_lane AS (SELECT c.case_key, c.risk_rank, c.latest, coalesce(s.disposition, 'open') AS disposition, c.risk_rank > 0 AND coalesce(s.disposition, 'open') NOT IN ('cleared', 'fraud_confirmed') AS needs_review FROM v_case c LEFT JOIN v_state s ON c.case_key = s.case_key)"""


def _lanes(spark: SparkSession, d: str) -> DataFrame:
    found = cases.with_defaults(cases.grouped(V.reports(spark, d)), cases.folded(V.case_events(spark, d), columns=["status", "disposition", "priority"]))
    level = cases.rank_name(F.col("risk_rank"))
    return found.withColumn("risk_level", level).withColumn("needs_review", cases.needs_review(level, F.col("disposition"))).withColumn("lane", cases.lane(level, F.col("disposition")))


@query("SELECT case_key, risk_rank::BIGINT AS risk_rank, latest, needs_review FROM v_lane ORDER BY needs_review DESC, risk_rank DESC, latest DESC, case_key LIMIT 50", f"{V.CASE_EVENTS}, {_QUEUE}")
def case_queue(spark: SparkSession, d: str) -> DataFrame:
    return cases.queue(_lanes(spark, d), 50).select("case_key", *longs("risk_rank"), "latest", "needs_review")


@query("SELECT CASE WHEN needs_review THEN 'needs_review' WHEN risk_rank > 0 THEN 'resolved' ELSE 'auto_approved' END AS lane, count(*) AS n FROM v_lane GROUP BY 1", f"{V.CASE_EVENTS}, {_QUEUE}")
def case_lanes(spark: SparkSession, d: str) -> DataFrame:
    return _lanes(spark, d).groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entity_ref, source_name, document_type, doc_id, generated_at FROM v_report QUALIFY row_number() OVER (PARTITION BY entity_ref, source_name, document_type ORDER BY generated_at DESC, doc_id DESC) = 1", V.REPORTS)
def latest_scans(spark: SparkSession, d: str) -> DataFrame:
    return entities.latest(V.reports(spark, d), ["entity_ref", "source_name", "document_type"], F.desc("generated_at"), F.desc("doc_id")).select("entity_ref", "source_name", "document_type", "doc_id", "generated_at")


@query("SELECT r.*, s.* FROM (SELECT count(*) AS n_scans, count_if(risk_level = 'high') AS n_high, count_if(risk_level = 'medium') AS n_medium, count_if(risk_level = 'low') AS n_low, CAST(round(avg(truth_score) * 10) AS BIGINT) AS score_tenths FROM v_report) r, (SELECT count_if(coalesce(disposition, 'open') NOT IN ('cleared', 'fraud_confirmed')) AS n_open, count_if(disposition = 'cleared') AS n_cleared, count_if(disposition = 'fraud_confirmed') AS n_fraud FROM v_state) s", V.CASE_EVENTS)
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    found = reports.dashboard(V.reports(spark, d), cases.folded(V.case_events(spark, d), columns=["disposition"]))
    return found.withColumn("score_tenths", F.round(F.col("avg_score") * 10).cast("bigint")).drop("avg_score")


@query("SELECT entity_ref, count(*) AS n_scans, arg_max(risk_level, generated_at) AS latest_risk, arg_max(truth_score, generated_at)::BIGINT AS latest_score, max(generated_at) AS latest FROM v_report GROUP BY 1", V.REPORTS)
def entity_cards(spark: SparkSession, d: str) -> DataFrame:
    found = reports.entity_cards(V.reports(spark, d))
    return found.withColumn("latest_score", F.col("latest_score").cast("bigint"))


@query("SELECT c_custkey AS id, 'BT-' || c_custkey AS entity_ref, n AS n_documents FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 20) JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def newest_entities(spark: SparkSession, d: str) -> DataFrame:
    people = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("BT-"), F.col("c_custkey")).alias("entity_ref"))
    return reports.newest_with_counts(people, V.reports(spark, d)).select("id", "entity_ref", "n_documents")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77') ORDER BY c_custkey DESC LIMIT 25")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return entities.search(V.table(spark, d, "customer"), "77", ["c_name", "c_mktsegment"], 25, "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


def _registry(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "supplier")
    return s.select(F.format_string("BT-%06d", "s_suppkey").alias("entity_ref"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("P"), F.col("s_suppkey"))).alias("pan"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("A"), F.col("s_suppkey"))).alias("aadhaar"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("first_name"), F.concat(F.lit("b"), F.col("s_suppkey") % 7).alias("last_name"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.lit("p"), F.col("c_custkey") % 500).alias("pan"), F.concat(F.lit("a"), F.col("c_custkey") % 400).alias("aadhaar"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("first_name"), F.concat(F.lit("b"), F.col("c_custkey") % 9).alias("last_name"))


@query(
    """SELECT c.c_custkey, coalesce(p.r, a.r, n.r) AS entity_ref, CASE WHEN p.r IS NOT NULL THEN 'pan' WHEN a.r IS NOT NULL THEN 'aadhaar' WHEN n.r IS NOT NULL THEN 'first_name+last_name' END AS matched_by FROM customer c
  LEFT JOIN (SELECT s_suppkey AS k, min(printf('BT-%06d', s_suppkey)) AS r FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) p ON c.c_custkey % 500 = p.k
  LEFT JOIN (SELECT s_suppkey AS k, min(printf('BT-%06d', s_suppkey)) AS r FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) a ON c.c_custkey % 400 = a.k
  LEFT JOIN (SELECT s_nationkey AS k, s_suppkey % 7 AS l, min(printf('BT-%06d', s_suppkey)) AS r FROM supplier GROUP BY 1, 2) n ON c.c_nationkey = n.k AND c.c_custkey % 9 = n.l"""
)
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    return entities.resolve(_people(spark, d), _registry(spark, d)).select("c_custkey", "entity_ref", "matched_by")


@query("SELECT o_orderpriority || '/' || o_orderstatus AS grp, printf('BT-%06d', row_number() OVER (ORDER BY min(o_orderkey)) + (SELECT max(s_suppkey) FROM supplier)) AS new_ref FROM orders GROUP BY o_orderpriority, o_orderstatus")
def minted_references(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("grp"), "o_orderkey", F.lit(None).cast("string").alias("entity_ref"), F.col("o_orderstatus").alias("first_name"), *[F.lit(None).cast("string").alias(x) for x in ("pan", "aadhaar", "email", "phone")])
    return entities.mint(o, _registry(spark, d), "grp", "o_orderkey")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'E' || o_orderkey END, first_value(CASE WHEN o_orderkey % 5 = 0 THEN 'E' || o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS entity_ref FROM orders")
def batch_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("E"), F.col("o_orderkey"))).alias("entity_ref"))
    return entities.carried_forward(rows).select("o_orderkey", "entity_ref")


@query(r"SELECT value, count(DISTINCT doc_id) AS n_cases, min(doc_id) AS first_case FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]+'))) AS value FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def shared_emails(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.]+"), F.lit(0))
    rows = V.table(spark, d, "documents").select("doc_id", F.explode(F.transform(found, lambda x: F.lower(x))).alias("email"))
    return entities.shared_attributes(rows, "email", "doc_id")


@query("SELECT case_key, CASE WHEN risk_level = 'high' THEN 'triage' WHEN risk_level = 'medium' THEN 'new' ELSE 'closed' END AS status, CASE WHEN risk_level = 'low' THEN 'cleared' ELSE 'open' END AS disposition, CASE WHEN risk_level = 'high' THEN 'high' ELSE 'normal' END AS priority FROM (SELECT r.case_key, r.risk_level, s.case_key IS NOT NULL AS seen, coalesce(s.disposition, 'open') AS disp FROM v_report r LEFT JOIN (SELECT * FROM v_state WHERE right(case_key, 1) <> '7') s ON r.case_key = s.case_key) WHERE disp NOT IN ('cleared', 'fraud_confirmed') AND (risk_level IN ('high', 'medium') OR NOT seen)", V.CASE_EVENTS)
def case_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """All assessments against the state at one time; cases whose key ends in 7 have no state yet, so that some are unseen."""
    state = cases.folded(V.case_events(spark, d), columns=["disposition"]).where("right(case_key, 1) <> '7'")
    return cases.lifecycle(V.reports(spark, d).select("case_key", "risk_level"), state)


@query("SELECT case_key, 'triage' AS status, 'open' AS disposition, 'high' AS priority FROM v_state WHERE disposition = 'cleared' AND case_key IN (SELECT 'payslip::BT-' || person FROM v_anomaly WHERE severity = 'high')", f"{V.CASE_EVENTS}, {V.SERIES}, {_DELTA}, {_ANOMALY}")
def reopened_cases(spark: SparkSession, d: str) -> DataFrame:
    found = series.anomalies(V.series(spark, d)).where("severity = 'high'").select(F.concat(F.lit("BT-"), F.col("person")).alias("entity_ref"))
    return cases.reopened(found, cases.folded(V.case_events(spark, d), columns=["disposition"]))


@query("SELECT entity_ref, CASE WHEN bool_and(risk_level = 'low') THEN 'PASSED' WHEN bool_or(risk_level = 'high') THEN 'FAILED' ELSE 'REVIEW' END AS overall FROM v_report GROUP BY 1", V.REPORTS)
def overall_verdicts(spark: SparkSession, d: str) -> DataFrame:
    level = F.col("risk_level")
    return reports.overall_verdict(V.reports(spark, d).withColumn("verdict", F.when(level == "low", "PASS").when(level == "high", "FAIL").otherwise("REVIEW")))


@query("SELECT * FROM (SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents)")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.table_counts(**{t: V.table(spark, d, t) for t in ("customer", "orders", "documents")})


@query("SELECT o_custkey, count_if(o_orderstatus = 'F') AS \"n_F\", count_if(o_orderstatus = 'O') AS \"n_O\", count_if(o_orderstatus = 'P') AS \"n_P\" FROM orders GROUP BY 1")
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.counts_by(V.table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


# logs

@query("SELECT CASE WHEN level IN ('INFO', 'DEBUG') THEN 'INFO' ELSE level END AS level, count(*) AS n FROM v_log GROUP BY 1", V.LOGS)
def log_levels(spark: SparkSession, d: str) -> DataFrame:
    return reports.log_levels(V.logs(spark, d))


@query("SELECT module, count(*) AS n, count_if(level = 'ERROR') AS n_errors FROM v_log GROUP BY 1 ORDER BY n DESC, module LIMIT 10", V.LOGS)
def top_modules(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_modules(V.logs(spark, d))


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, level, count(*) AS n FROM v_log GROUP BY 1, 2", V.LOGS)
def log_volume(spark: SparkSession, d: str) -> DataFrame:
    found = flows.log_volume(V.logs(spark, d))
    return found.select(F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "level", "n")


@query("SELECT strftime(date_trunc('minute', ts) - to_minutes(k), '%Y-%m-%d %H:%M:%S') AS start, count_if(level = 'ERROR') AS n_errors, count(*) AS n FROM v_log, generate_series(0, 9) g(k) GROUP BY 1", V.LOGS)
def live_errors(spark: SparkSession, d: str) -> DataFrame:
    found = flows.live_errors(V.logs(spark, d))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_errors", "n")


# reconciliation

@query(
    """SELECT case_id, type, severity, CAST(delta AS BIGINT) AS delta FROM (
  SELECT case_id, 'payslip_vs_form16_salary_mismatch' AS type, 'high' AS severity, abs(avg_gross * 12 - form16_gross) AS delta FROM v_evidence WHERE avg_gross > 0 AND abs(avg_gross * 12 - form16_gross) / greatest(form16_gross, 1) > 0.15
  UNION ALL SELECT case_id, 'payslip_vs_offer_letter_salary_mismatch', 'high', abs(avg_gross * 12 - annual_ctc) FROM v_evidence WHERE avg_gross > 0 AND abs(avg_gross * 12 - annual_ctc) / greatest(annual_ctc, 1) > 0.15
  UNION ALL SELECT case_id, 'offer_letter_vs_form16_salary_mismatch', 'medium', abs(annual_ctc - form16_gross) FROM v_evidence WHERE avg_gross > 0 AND abs(annual_ctc - form16_gross) / greatest(form16_gross, 1) > 0.15
  UNION ALL SELECT case_id, 'payslip_net_vs_bank_salary_credit_mismatch', 'high', abs(avg_net - avg_salary_credit) FROM v_evidence WHERE avg_gross > 0 AND abs(avg_net - avg_salary_credit) / greatest(avg_salary_credit, 1) > 0.15
  UNION ALL SELECT case_id, 'pan_mismatch_payslip_vs_form16', 'high', NULL FROM v_evidence WHERE avg_gross > 0 AND payslip_pan <> form16_pan
  UNION ALL SELECT case_id, 'bank_name_payslip_vs_statement_mismatch', 'high', NULL FROM v_evidence WHERE avg_gross > 0 AND NOT contains(statement_bank, 'HDFC'))""",
    V.INCOME,
)
def income_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.checks(reconcile.evidence(V.income_documents(spark, d)))


@query("SELECT account AS case_id, count(*) AS n_matches FROM (SELECT account, unnest([debit, credit]) AS amount FROM v_ledger) WHERE amount > 10000 AND abs(amount - (20000 + account * 100)) * 100 <= (20000 + account * 100) * 2 GROUP BY 1", V.LEDGER)
def gift_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ledger(spark, d).withColumnRenamed("account", "case_id")
    gifts = rows.select("case_id").distinct().withColumn("gift_amount", 20_000 + F.col("case_id") * 100)
    return reconcile.gift_matches(gifts, rows).select("case_id", "n_matches")


@query("SELECT case_id, CASE max(r) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS bundle_risk FROM (SELECT entity_ref AS case_id, CASE risk_level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS r FROM v_report UNION ALL SELECT 'BT-' || person, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END FROM v_anomaly) GROUP BY 1", f"{V.REPORTS}, {V.SERIES}, {_DELTA}, {_ANOMALY}")
def bundle_risk(spark: SparkSession, d: str) -> DataFrame:
    found = series.anomalies(V.series(spark, d)).select(F.concat(F.lit("BT-"), F.col("person")).alias("case_id"), "severity")
    return reports.bundle(V.reports(spark, d).withColumnRenamed("entity_ref", "case_id"), found)


# identity

#: Keys on a side of a cell of name_matches, keys in a run of its rows, and rows of a task.
CELL, RUN, TASK_ROWS = 1500, 200, 100_000_000


@query("SELECT a.label::BIGINT AS block, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.40")
def embedding_links(spark: SparkSession, d: str) -> DataFrame:
    return identity.embedding_links(V.table(spark, d, "embeddings")).select(*longs("block"), "a", "b")


@query("SELECT a.vec_id AS query, b.vec_id AS match FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.40")
def embedding_search(spark: SparkSession, d: str) -> DataFrame:
    """J12 over all labels: every vec_id divisible by 100 against all rows."""
    return identity.embedding_search(V.table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0).select("query", "match")


@query("SELECT c_custkey, s_suppkey, CAST(len(list_intersect(x, y)) AS BIGINT) AS shared FROM (SELECT c_custkey, c_nationkey, list_distinct(string_split(lower(c_mktsegment || ' nation ' || c_nationkey), ' ')) AS x FROM customer) JOIN (SELECT s_suppkey, s_nationkey, list_distinct(string_split(lower('supplier nation ' || s_nationkey), ' ')) AS y FROM supplier) ON c_nationkey = s_nationkey WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.5")
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """J11 within a nation. Each pair of different texts is compared once; the rows that share a text meet by key, so that no words are cut for a pair of rows.

    Nearly all pairs of a nation are rows of the result, so keys meet as arrays, a cell of a grid in a row, and cells are dealt evenly over as many tasks as the
    rows need. A cell gives its rows a supplier at a time for a few customers at a time: a table of them holds a hundredth of their size then.
    """
    c = V.table(spark, d, "customer").select("c_custkey", "c_nationkey", F.concat_ws(" ", F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("x"))
    s = V.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.concat_ws(" ", F.lit("supplier nation"), F.col("s_nationkey").cast("string")).alias("y"))
    words = lambda v: F.array_distinct(F.split(F.lower(v), " "))
    # texts are as few as segments times nations
    c_texts, s_texts = c.groupBy("c_nationkey", "x").agg(F.count(F.lit(1)).alias("c_rows")), s.groupBy("s_nationkey", "y").agg(F.count(F.lit(1)).alias("s_rows"))
    texts = c_texts.join(s_texts, F.col("c_nationkey") == F.col("s_nationkey"))
    alike = written(texts.where(X.word_jaccard(F.col("x"), F.col("y")) >= 0.5).withColumn("shared", F.size(F.array_intersect(words("x"), words("y"))).cast("bigint")))

    def chunks(rows: DataFrame, key: str, by: list[str], texts: DataFrame, n: str) -> DataFrame:
        cut = rows.join(F.broadcast(texts), by).withColumn("__cut", F.pmod(F.xxhash64(key), F.ceil(F.col(n) / CELL)))
        return cut.groupBy(*by, "__cut").agg(F.array_sort(F.collect_list(key)).alias(f"{key}s")).drop("__cut")

    c_chunks, s_chunks = chunks(c, "c_custkey", ["c_nationkey", "x"], c_texts, "c_rows"), chunks(s, "s_suppkey", ["s_nationkey", "y"], s_texts, "s_rows")
    cells = c_chunks.join(F.broadcast(alike.select("c_nationkey", "x", "y", "shared")), ["c_nationkey", "x"]).join(s_chunks.withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey", "y"])
    rows = alike.agg(F.sum(F.col("c_rows") * F.col("s_rows"))).first()[0] or 0
    # few rows grow to many: cells are spread by a fixed number, which Spark doesn't lower for their size
    tasks = max(96, 2 * spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    cells = cells.select("c_custkeys", "s_suppkeys", "shared").repartition(tasks, "c_custkeys", "s_suppkeys")
    few = F.transform(F.sequence(F.lit(1), F.size("c_custkeys"), F.lit(RUN)), lambda i: F.slice("c_custkeys", i, RUN))
    runs = one_by_one(one_by_one(cells.select(F.explode(few).alias("run"), "s_suppkeys", "shared")).select("run", F.explode("s_suppkeys").alias("s_suppkey"), "shared"))
    return runs.select(F.explode("run").alias("c_custkey"), "s_suppkey", "shared")


@query("SELECT check_type, status, verdict, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'face_match' ELSE 'video_kyc' END AS check_type, o_orderkey % 2 = 0 AS m, o_orderkey % 5 < 3 AS l, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN m THEN 'pass' ELSE 'fail' END WHEN m AND l THEN 'pass' WHEN m OR l THEN 'inconclusive' ELSE 'fail' END AS status, CASE WHEN CASE WHEN o_orderkey % 3 = 0 THEN m ELSE m AND l END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM orders) GROUP BY ALL")
def kyc_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select(F.when(k % 3 == 0, "face_match").otherwise("video_kyc").alias("check_type"), (k % 2 == 0).alias("m"), (k % 5 < 3).alias("l"))
    v = identity.kyc_verdict(F.col("check_type"), F.col("m"), F.col("l"))
    return rows.select("check_type", v.alias("v")).groupBy("check_type", F.col("v.status").alias("status"), F.col("v.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT session_id, CAST(min(frame_no) FILTER (n >= 3 AND hi >= 0.62) AS BIGINT) AS turn_left, CAST(min(frame_no) FILTER (n >= 3 AND lo <= 0.38) AS BIGINT) AS turn_right, CAST(min(frame_no) FILTER (n >= 6 AND hp - lp >= 0.28) AS BIGINT) AS nod, count(*) AS n_frames FROM (SELECT session_id, frame_no, row_number() OVER w AS n, max(nose_rel_x) OVER v AS hi, min(nose_rel_x) OVER v AS lo, max(pitch) OVER v AS hp, min(pitch) OVER v AS lp FROM v_frame WINDOW w AS (PARTITION BY session_id ORDER BY frame_no), v AS (PARTITION BY session_id ORDER BY frame_no ROWS 19 PRECEDING)) GROUP BY 1", V.FRAMES)
def liveness_windows(spark: SparkSession, d: str) -> DataFrame:
    return kyc.first_passes(V.frames(spark, d))


# evaluation, statistics, clusters

@query("SELECT count_if(p AND t) AS tp, count_if(p AND NOT t) AS fp, count_if(NOT p AND t) AS fn, count_if(NOT p AND NOT t) AS tn FROM (SELECT regexp_matches(lower(text), 'idiot|scum|loser|moron') AS p, toxic <> 0 AS t FROM documents JOIN labels USING (doc_id))")
def flag_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id")
    return evaluate.confusion(rows, F.lower("text").rlike("idiot|scum|loser|moron"), F.col("toxic")).select("tp", "fp", "fn", "tn")


@query("SELECT type, count(*) AS n, count_if(flag) AS detected FROM (SELECT unnest(string_split(o_orderpriority || '|' || o_orderstatus, '|')) AS type, o_totalprice > 100000 AS flag FROM orders) GROUP BY 1")
def detection_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "orders").withColumn("kinds", F.concat_ws("|", "o_orderpriority", "o_orderstatus"))
    return evaluate.by_type(rows, "kinds", F.col("o_totalprice") > 100_000)


@query("SELECT l_orderkey // 160 AS image, count(*) AS n_blocks, CAST(round(CASE WHEN avg(s) < 1e-6 THEN 0 ELSE stddev_pop(s) / avg(s) END * 1000) AS BIGINT) AS cv_thousandths FROM (SELECT l_orderkey // 160 AS i, l_orderkey // 16 AS b, any_value(l_orderkey) AS l_orderkey, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def block_noise(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "lineitem").select(F.expr("l_orderkey div 160").alias("image"), F.expr("l_orderkey div 16").alias("block"), "l_quantity")
    return blocks.noise_cv(rows, "image", ["block"], "l_quantity").select("image", "n_blocks", F.round(F.col("noise_cv") * 1000).cast("bigint").alias("cv_thousandths"))


@query("SELECT image, count_if(s / n >= greatest(5.0, 2 * t / m)) AS n_high, count(*) AS n_blocks FROM (SELECT *, sum(s) OVER (PARTITION BY image) AS t, sum(n) OVER (PARTITION BY image) AS m FROM (SELECT l_orderkey // 160 AS image, l_orderkey // 4 AS b, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)) GROUP BY 1")
def block_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "lineitem").select(F.expr("l_orderkey div 160").alias("image"), F.expr("l_orderkey div 4").alias("block"), "l_quantity")
    return blocks.high_error_share(rows, "image", ["block"], "l_quantity")


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS node, 'n' || (s_suppkey % 41) AS v FROM supplier UNION ALL SELECT s_suppkey, 'm' || (s_suppkey // 30) FROM supplier WHERE s_suppkey % 2 = 0), r(node, low) AS (SELECT node, node FROM e UNION SELECT b.node, r.low FROM r JOIN e a ON r.node = a.node JOIN e b ON a.v = b.v) SELECT node, min(low) AS cluster FROM r GROUP BY 1")
def shared_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 41).alias("n"), F.when(F.col("s_suppkey") % 2 == 0, F.expr("s_suppkey div 30")).alias("m"))
    return clusters.shared_clusters(rows, "node", ["n", "m"])


# streams, run over what there is

def _log_stream(spark: SparkSession, d: str) -> DataFrame:
    events = spark.readStream.schema(V.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return V.log_rows(events)


@query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, level, count(*) AS n FROM v_log GROUP BY date_trunc('minute', ts), level HAVING date_trunc('minute', ts) + INTERVAL 6 MINUTE <= (SELECT max(ts) FROM v_log)", V.LOGS)
def streamed_log_volume(spark: SparkSession, d: str) -> DataFrame:
    """L13 as a stream: windows of a minute under a watermark of five; the sink holds the closed ones."""
    base = shared_dir(spark)
    found = flows.run_once(flows.log_volume(_log_stream(spark, d)), spark, f"{base}/sink", f"{base}/checkpoint")
    return found.select(F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "level", "n")


@query("SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count_if(level = 'ERROR') AS n_errors, count(*) AS n FROM (SELECT date_trunc('minute', ts) - to_minutes(k) AS w, level FROM v_log, generate_series(0, 9) g(k)) GROUP BY w HAVING w + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM v_log)", V.LOGS)
def streamed_live_errors(spark: SparkSession, d: str) -> DataFrame:
    """L14 as a stream: sliding windows of ten minutes under a watermark of five; the sink holds the closed ones."""
    base = shared_dir(spark)
    found = flows.run_once(flows.live_errors(_log_stream(spark, d)), spark, f"{base}/sink", f"{base}/checkpoint")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_errors", "n")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, level, count(*) AS n FROM v_log GROUP BY 1, 2", V.LOGS)
def streamed_log_days(spark: SparkSession, d: str) -> DataFrame:
    """Days summed from the minutes that the stream has closed, and those of the batch twin that it has not."""
    base = shared_dir(spark)
    closed = flows.run_once(flows.log_volume(_log_stream(spark, d)), spark, f"{base}/sink", f"{base}/checkpoint")
    last = closed.agg(F.max("minute").alias("last"))
    later = V.logs(spark, d).crossJoin(F.broadcast(last)).where(F.coalesce(F.date_trunc("minute", "ts") > F.col("last"), F.lit(True))).drop("last")
    rest = flows.log_volume(later)
    return closed.unionByName(rest).groupBy(F.date_format("minute", "yyyy-MM-dd").alias("day"), "level").agg(F.sum("n").alias("n"))


@query(SQL["payslip_scores"])
def streamed_scores(spark: SparkSession, d: str) -> DataFrame:
    """The batch rules over a stream of summaries."""
    base = shared_dir(spark)
    slips = written(V.spread(V.slips(spark, d), "person", "period"), f"{base}/slips")
    found = flows.score_stream(spark.readStream.schema(slips.schema).parquet(f"{base}/slips"), types=["payslip"], with_signals=False)
    found = found.select("person", F.col("period").cast("string").alias("period"), *longs("risk_score", "truth_score"), "risk_level")
    return flows.run_once(found, spark, f"{base}/sink", f"{base}/checkpoint")


@query("SELECT doc_id, CASE WHEN greatest(licence, secret, english, german) = 0 THEN 'generic' WHEN licence = greatest(licence, secret, english, german) THEN 'licence' WHEN secret = greatest(secret, english, german) THEN 'secret' WHEN english >= german THEN 'english' ELSE 'german' END AS doc_type FROM s", V.CLASSES)
def streamed_classification(spark: SparkSession, d: str) -> DataFrame:
    """The batch expressions over a stream."""
    base = shared_dir(spark)
    docs = spark.readStream.schema(V.table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    found = docs.select("doc_id", extract.classify(F.lit(""), F.col("text"), V.TAXONOMY)["type"].alias("doc_type"))
    return flows.run_once(found, spark, f"{base}/sink", f"{base}/checkpoint")


# each challenge starts after the frame that the one before passed at; four of them need no recursion
_LIVE = """v_f AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, event_id AS frame_no, ts, CAST(event_id * 37 % 101 / 100.0 AS DOUBLE) AS x, CAST(event_id * 53 % 89 / 100.0 AS DOUBLE) AS y, CAST(event_id * 29 % 40 / 100.0 AS DOUBLE) AS ear,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY event_id) AS n FROM events),
v_1 AS (SELECT f.session_id, min(f.n) AS n FROM v_f f JOIN v_f j ON f.session_id = j.session_id AND j.n BETWEEN f.n - 19 AND f.n WHERE f.n >= 3 AND j.x >= 0.62 GROUP BY 1),
v_2 AS (SELECT f.session_id, min(f.n) AS n FROM v_1 p JOIN v_f f ON p.session_id = f.session_id AND f.n >= p.n + 3 JOIN v_f j ON f.session_id = j.session_id AND j.n BETWEEN greatest(p.n + 1, f.n - 19) AND f.n WHERE j.x <= 0.38 GROUP BY 1),
v_3 AS (SELECT session_id, min(n) AS n FROM (SELECT f.session_id, f.n FROM v_2 p JOIN v_f f ON p.session_id = f.session_id AND f.n >= p.n + 6 JOIN v_f j ON f.session_id = j.session_id AND j.n BETWEEN greatest(p.n + 1, f.n - 19) AND f.n
  GROUP BY 1, 2 HAVING max(j.y) - min(j.y) >= 0.28) GROUP BY 1),
v_4 AS (SELECT session_id, min(n) AS n FROM (SELECT f.session_id, f.n FROM v_3 p JOIN v_f f ON p.session_id = f.session_id AND f.n >= p.n + 8 JOIN v_f j ON f.session_id = j.session_id AND j.n BETWEEN p.n + 1 AND f.n
  GROUP BY f.session_id, f.n, p.n HAVING sum(j.ear ORDER BY j.n) FILTER (j.n <= p.n + 5) / 5 > 0.18 AND min(j.ear) FILTER (j.n > p.n + 5) < 0.15 AND sum(j.ear ORDER BY j.n) FILTER (j.n > f.n - 5) / 5 > 0.18) GROUP BY 1),
v_passed AS (SELECT *, 'turn_left' AS challenge, 1 AS passed FROM v_1 UNION ALL SELECT *, 'turn_right', 2 FROM v_2 UNION ALL SELECT *, 'nod', 3 FROM v_3 UNION ALL SELECT *, 'blink', 4 FROM v_4),
v_last AS (SELECT session_id, max(ts) AS ts FROM v_f GROUP BY 1)"""


@query(
    """SELECT p.session_id, f.frame_no, CASE WHEN passed = 4 THEN 'completed' ELSE 'challenge_passed' END AS status, challenge, passed::INTEGER AS passed, CAST(NULL AS DOUBLE) AS similarity FROM v_passed p JOIN v_f f ON p.session_id = f.session_id AND p.n = f.n
  UNION ALL SELECT l.session_id, -1, 'expired', '', coalesce(p.passed, 0)::INTEGER, NULL FROM v_last l LEFT JOIN (SELECT session_id, max(passed) AS passed FROM v_passed GROUP BY 1) p ON l.session_id = p.session_id
  WHERE coalesce(p.passed, 0) < 4 AND l.ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    _LIVE,
)
def liveness_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events of all four challenges by keyed state, and the sessions that expire."""
    base = shared_dir(spark)
    V.frames(spark, d).write.parquet(f"{base}/frames")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/frames").schema).parquet(f"{base}/frames")
    with flows.rocksdb(spark):
        return flows.run_once(kyc.sessions(stream), spark, f"{base}/sink", f"{base}/checkpoint")
