"""Entities: identity fields of reports, resolution against a registry, new references, latest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsleuth.functions import fixed
from docsleuth.functions import scalars as X
from docsleuth.sources.shared import written


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; one shuffle on the key."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def identity_fields(key_fields: Column, named: Column) -> Column:
    """Name, phone, identity numbers and e-mail by label, else by pattern among all values."""
    pick = lambda *ks: X.first_filled(*[key_fields[k] for k in ks], *[F.get(named[k], 0) for k in ks])
    values = F.flatten(F.map_values(named))
    like = lambda p: F.get(F.filter(values, lambda v: v.rlike(p)), 0)
    name = F.coalesce(pick("employee_name", "name", "account_holder", "insured_name", "patient_name"), like(r"^[A-Z][a-z]+(?: [A-Z][a-z]+)+$"))
    words = F.split(F.trim(name), r"\s+")
    aadhaar = F.regexp_replace(F.coalesce(pick("aadhaar", "aadhar", "aadhaar_number"), like(r"^\d{4}\s?\d{4}\s?\d{4}$")), r"\s", "")
    pan = F.upper(F.coalesce(pick("pan", "pan_number", "pan_of_employee"), like(fixed.PAN)))
    return F.struct(
        F.get(words, 0).alias("first_name"),
        X.blank_to_null(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")).alias("last_name"),
        F.left(F.regexp_replace(pick("phone", "mobile", "phone_number", "mobile_number"), r"[^\d+]", ""), F.lit(20)).alias("phone"),
        pan.alias("pan"),
        aadhaar.alias("aadhaar"),
        F.lower(F.coalesce(pick("email", "email_id"), like(r"^[\w.+-]+@[\w-]+\.[\w.]+$"))).alias("email"),
    )


def resolve(people: DataFrame, registry: DataFrame, keys: list[list[str]] | None = None, strict: bool = False) -> DataFrame:
    """entity_ref by PAN, else Aadhaar, else name; the first key that hits wins.

    Each key's registry is reduced to one row a value first, so no join multiplies. strict also refuses a hit by a
    later key where both sides have a PAN and they differ.
    """
    keys = keys or [["pan"], ["aadhaar"], ["first_name", "last_name"]]
    out = people
    for k, cols in enumerate(keys):
        norm = [F.lower(F.trim(F.col(c))) for c in cols]
        filled = norm[0].isNotNull() & (norm[0] != "")
        one = registry.where(filled).groupBy(*[n.alias(f"__k{i}") for i, n in enumerate(norm)]).agg(F.min("entity_ref").alias(f"__ref{k}"), F.min_by("pan", "entity_ref").alias(f"__pan{k}"))
        cond = None
        for i, c in enumerate(cols):
            own = F.lower(F.trim(out[c]))
            # people without the key match no one, but are spread over all tasks by what else is known of them
            own = own if i else F.coalesce(X.blank_to_null(own), F.concat(F.lit("\u0000"), F.xxhash64(*[out[x] for x in people.columns]).cast("string")))
            part = own == F.col(f"__k{i}")
            cond = part if cond is None else cond & part
        out = out.join(one, cond, "left").drop(*[f"__k{i}" for i in range(len(cols))])
        if strict and k:
            clash = F.col(f"__pan{k}").isNotNull() & F.col("pan").isNotNull() & (F.col(f"__pan{k}") != F.col("pan"))
            out = out.withColumn(f"__ref{k}", F.when(~clash, F.col(f"__ref{k}")))
    refs = [F.col(f"__ref{k}") for k in range(len(keys))]
    by = F.coalesce(*[F.when(r.isNotNull(), F.lit("+".join(c))) for r, c in zip(refs, keys, strict=True)])
    return out.withColumn("entity_ref", F.coalesce(*refs)).withColumn("matched_by", by).drop(*[f"__{x}{k}" for k in range(len(keys)) for x in ("ref", "pan")])


def mint(people: DataFrame, registry: DataFrame, group: str, order: str) -> DataFrame:
    """References BT-000001, ... above the registry's largest, one for each group without one, in the order first seen.

    Groups are numbered by range partitions: counts of each range are summed, so no task sorts all groups.
    """
    some = F.coalesce(*[X.blank_to_null(F.col(c)) for c in ("first_name", "pan", "aadhaar", "email", "phone")])
    fresh = people.where(F.col("entity_ref").isNull() & some.isNotNull()).groupBy(group).agg(F.min(order).alias("first_seen"))
    top = registry.agg(F.coalesce(F.max(F.substring("entity_ref", 4, 12).try_cast("bigint")), F.lit(0)).alias("top"))
    return numbered(fresh, "first_seen", group).crossJoin(F.broadcast(top)).select(group, F.format_string("BT-%06d", F.col("n") + F.col("top")).alias("new_ref"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """n = 1, 2, ... in the given order, of any type, without one task that sorts all rows: ranges sorted apart, each counting on from those before.

    The ranges are cut by all order columns, so rows that agree in the first one may lie in several.
    """
    dealt = df.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    # written as sorted: range and place are the same for the counts and for the rows
    placed = written(dealt.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("c"), F.min("__at").alias("__first"))  # a row for each range
    before = counts.select("__range", "__first", F.coalesce(F.sum("c").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__range").withColumn("n", F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__range", "__at", "__first", "__before")


def linked(people: DataFrame, forced: DataFrame, operator_fields: list[str]) -> DataFrame:
    """A forced reference beats the resolved one where it is known; an operator's field beats an extracted one."""
    out = people.join(forced.select(F.col("entity_ref").alias("__known")).distinct(), F.col("forced_ref") == F.col("__known"), "left")
    out = out.withColumn("entity_ref", F.coalesce("__known", "entity_ref")).drop("__known")
    return out.withColumns({f: X.first_filled(F.col(f"op_{f}"), F.col(f)) for f in operator_fields})


def carried_forward(batch: DataFrame, key: str = "batch_id", order: str = "idx") -> DataFrame:
    """The first reference resolved in a batch goes to its other rows."""
    first = F.first("entity_ref", ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return batch.withColumn("entity_ref", F.coalesce("entity_ref", first))


def updated(current: DataFrame, changes: DataFrame, columns: list[str], stamp: Column) -> DataFrame:
    """A new snapshot with the changed columns, trimmed, and the time of change."""
    c = changes.select(F.col("entity_ref").alias("__ref"), *[F.trim(x).alias(f"__{x}") for x in columns])
    out = current.join(c, F.col("entity_ref") == F.col("__ref"), "left")
    hit = F.col("__ref").isNotNull()
    return out.withColumns({x: F.coalesce(F.col(f"__{x}"), F.col(x)) for x in columns} | {"updated_at": F.when(hit, stamp).otherwise(F.col("updated_at"))}).drop("__ref", *[f"__{x}" for x in columns])


def document_information(scans: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """entity_ref, doc_id, document_type, extracted_data of each scan with an entity; rows of current for other scans stay."""
    fields = F.coalesce("key_fields", F.create_map().cast("map<string,string>"))
    made = scans.where(F.col("entity_ref").isNotNull()).select("entity_ref", "doc_id", F.coalesce("document_type", F.lit("generic")).alias("document_type"), fields.alias("extracted_data"))
    return made if current is None else replaced(current, made, "doc_id")


def replaced(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and the old rows of other keys."""
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def search(df: DataFrame, query: str, columns: list[str], limit: int, newest: str) -> DataFrame:
    """Rows that contain the query in any of the columns, newest first; an empty query finds all."""
    out = df
    if query.strip():
        q = query.strip().lower()
        hit = None
        for c in columns:
            part = F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(q))
            hit = part if hit is None else hit | part
        out = df.where(hit)
    return out.orderBy(F.desc(newest)).limit(limit)


def shared_attributes(df: DataFrame, attribute: str, case: str) -> DataFrame:
    """Values that several cases have."""
    return df.where(X.blank_to_null(F.col(attribute)).isNotNull()).groupBy(F.col(attribute).alias("value")).agg(F.count_distinct(case).alias("n_cases"), F.min(case).alias("first_case")).where("n_cases >= 2")
