"""Monthly payslip series per person: changes, drops, drift, gaps. One window or aggregation on the person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANOMALY = ["person", "type", "severity", "from_period", "to_period"]


def deltas(rows: DataFrame, person: str = "person", period: str = "period", order: str = "ord") -> DataFrame:
    """Each payslip beside the one before; unknown periods come last."""
    w = Window.partitionBy(person).orderBy(F.col(period).asc_nulls_last(), order)
    out = rows
    for c in ("gross", "net", "deductions", "lop"):
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w)).withColumn(f"{c}_change", F.col(c) - F.col(f"prev_{c}"))
    return out.withColumn("prev_period", F.lag(period).over(w)).withColumn("nth", F.row_number().over(w))


def months_between(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def anomalies(rows: DataFrame, person: str = "person", period: str = "period", order: str = "ord") -> DataFrame:
    """One row per finding. All of them come from one window over the person's payslips."""
    d = deltas(rows, person, period, order)
    gap = months_between(F.col("prev_period"), F.col(period))
    drop = F.when((F.col("prev_net") > 0) & (F.col("net") < F.col("prev_net")), (F.col("prev_net") - F.col("net")) * 100 / F.col("prev_net"))
    found = {
        "gross_earnings_variance": (F.when((F.col("gross") != 0) & (F.col("prev_gross") != 0) & (F.abs("gross_change") * 4 >= F.greatest(F.col("prev_gross"), F.lit(1))), "medium"), F.abs("gross_change")),
        "deduction_spike": (F.when(F.col("deductions") > F.greatest(F.col("prev_deductions") * 1.5, F.col("prev_deductions") + 5000), "medium"), F.col("deductions_change")),
        "lop_days_increase": (F.when((F.col("lop") > 0) & (F.coalesce("prev_lop", F.lit(0)) == 0) & (F.col("nth") > 1), "low"), F.col("lop").cast("bigint")),
        "net_pay_drop_spike": (F.when(drop >= 50, "high").when(drop >= 30, "medium"), F.col("prev_net") - F.col("net")),
        "period_gap": (F.when(gap > 1, "medium"), (gap - 1).cast("bigint")),
        "duplicate_period": (F.when(gap == 0, "medium"), F.lit(0).cast("bigint")),
    }
    rows_of = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(F.lit(k).alias("type"), s.alias("severity"), v.cast("bigint").alias("amount"))) for k, (s, v) in found.items()]))
    return d.select(F.col(person).alias("person"), F.col("prev_period").alias("from_period"), F.col(period).alias("to_period"), F.explode(rows_of).alias("a")).select("person", "a.type", "a.severity", "from_period", "to_period", "a.amount")


def drift(rows: DataFrame, value: str, kind: str, severity: str, person: str = "person", period: str = "period", order: str = "ord") -> DataFrame:
    """People with more than one value, in the order first seen."""
    first = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]))
    out = rows.where(F.col(value).isNotNull()).groupBy(F.col(person).alias("person")).agg(first.alias("seen"), F.min(period).alias("from_period"), F.max(period).alias("to_period"))
    return out.where(F.size("seen") > 1).select("person", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), "from_period", "to_period", F.array_join("seen", ", ").alias("values"))


def summary(rows: DataFrame, person: str = "person", period: str = "period", order: str = "ord") -> DataFrame:
    """Payslips, comparisons and findings a person."""
    n = rows.groupBy(F.col(person).alias("person")).agg(F.count(F.lit(1)).alias("n_payslips"))
    a = anomalies(rows, person, period, order).groupBy("person").agg(F.count(F.lit(1)).alias("n_anomalies"))
    return n.join(a, "person", "left").select("person", "n_payslips", (F.col("n_payslips") - 1).alias("n_comparisons"), F.coalesce("n_anomalies", F.lit(0)).alias("n_anomalies"))
