"""Two reports compared: fixed, new, moved, changed, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import seeds
from webloom.operators.findings import weight
from webloom.operators.places import numbered

FIELDS = ["id", "severity", "category", "title", "url", "element", "seq"]


def _by_id(findings: DataFrame) -> DataFrame:
    """Findings with an id; of equal ids the last one counts."""
    rows = findings.where("id IS NOT NULL AND id <> ''")
    return rows.groupBy("id").agg(F.max_by(F.struct(*FIELDS[1:]), "seq").alias("f"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per finding: change, its fields, was_severity, was_url, trend.

    ``change`` is fixed | new | moved | changed | unchanged. A finding born on
    another page with the same (category, title, element) as one that went is
    moved; such partners are paired one to one in id order. The pairing numbers
    gone and born rows of a shape (``places.numbered``: many tasks for a shape with
    a third of all rows) and joins on (shape, number); shapes that only one side
    has never meet.
    """
    both = _by_id(old).withColumnRenamed("f", "o").join(_by_id(new).withColumnRenamed("f", "n"), "id", "full_outer")
    pick = lambda side: [F.col(f"{side}.{c}").alias(c) for c in FIELDS[1:-1]]
    same = both.where("o IS NOT NULL AND n IS NOT NULL").select(
        F.when(F.col("o.severity").eqNullSafe(F.col("n.severity")), "unchanged").otherwise("changed").alias("change"),
        "id", *pick("n"), F.col("o.severity").alias("was_severity"), F.lit(None).cast("string").alias("was_url"),
    )
    same = same.withColumn("was_severity", F.when(F.col("change") == "changed", F.col("was_severity")))
    shape = [F.coalesce("category", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("element", F.lit(""))]
    lone = F.coalesce("o", "n")
    alone = both.where("o IS NULL OR n IS NULL").select(
        F.col("n").isNotNull().alias("born"), "id", *[lone[c].alias(c) for c in FIELDS[1:-1]])
    alone = numbered(alone.withColumn("shape", F.sha2(F.concat_ws("\x1f", *shape), 256)), ["born", "shape"], ["id"], "moved")
    fields = F.struct("id", *FIELDS[1:-1])
    gone = alone.where(~F.col("born")).select("shape", "place", fields.alias("g"))
    born = alone.where("born").select("shape", "place", fields.alias("b"))
    met = born.join(gone, ["shape", "place"], "full_outer")
    none = F.lit(None).cast("string")
    shown = F.coalesce("b", "g")
    moved = F.col("b").isNotNull() & F.col("g").isNotNull()
    paired = met.select(
        F.when(moved, "moved").when(F.col("b").isNull(), "fixed").otherwise("new").alias("change"),
        *[shown[c].alias(c) for c in FIELDS[:-1]], none.alias("was_severity"),
        F.when(moved, F.coalesce("g.url", F.lit(""))).alias("was_url"),
    )
    out = same.unionByName(paired)
    now, before = weight("severity"), weight("was_severity")
    trend = F.when(F.col("change") == "changed", F.when(now < before, "worse").when(now > before, "better"))
    return out.withColumn("trend", trend)


def order_diff(changes: DataFrame) -> DataFrame:
    return changes.orderBy("change", weight("severity"), "title", "id")


def diff_counts(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """(kind, severity, n): totals of both reports (rows without id included), counts
    per change, and fixed and new per severity with all five present."""
    rows = (
        changes.select(F.col("change").alias("kind"), F.lit("").alias("severity"), F.lit(1).alias("n"))
        .unionByName(
            changes.where("change IN ('fixed', 'new')").select(
                F.concat("change", F.lit("_by_severity")).alias("kind"), F.coalesce("severity", F.lit("info")).alias("severity"), F.lit(1).alias("n")
            )
        )
        .unionByName(old.select(F.lit("old_total").alias("kind"), F.lit("").alias("severity"), F.lit(1).alias("n")))
        .unionByName(new.select(F.lit("new_total").alias("kind"), F.lit("").alias("severity"), F.lit(1).alias("n")))
    )
    kinds = ["fixed", "new", "moved", "changed", "unchanged", "old_total", "new_total"]
    zero = [(k, "", 0) for k in kinds] + [
        (f"{k}_by_severity", s, 0) for k in ("fixed", "new") for s in seeds.SEVERITY_ORDER
    ]
    zeros = changes.sparkSession.createDataFrame(zero, "kind string, severity string, n int")
    return rows.unionByName(zeros).groupBy("kind", "severity").agg(F.sum("n").alias("n"))


def worst_new(changes: DataFrame) -> DataFrame:
    """The most serious severity among new and worsened findings (null without any)."""
    fresh = changes.where("change = 'new' OR trend = 'worse'").select(F.coalesce("severity", F.lit("info")).alias("severity"))
    return fresh.agg(F.min_by("severity", F.struct(weight("severity"), F.col("severity"))).alias("worst"))


def fails_new(changes: DataFrame, severity: str) -> bool:
    limit = seeds.SEVERITY_ORDER.index(severity)
    fresh = changes.where("change = 'new' OR trend = 'worse'")
    return not fresh.where(weight("severity") <= limit).isEmpty()
