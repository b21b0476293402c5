"""Findings: their shape, merging, ordering, summaries, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom import seeds
from webloom.session import cut_lineage

COLUMNS = {
    "seq": "bigint", "severity": "string", "category": "string", "title": "string", "detail": "string", "url": "string",
    "element": "string", "evidence": "map<string,string>", "screenshot": "string", "how_to_fix": "string",
    "occurrences": "bigint", "other_urls": "array<string>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())


def evidence(**values) -> Column:
    """Evidence map; values that are not text are written as JSON."""
    if not values:
        return F.from_json(F.lit("{}"), "map<string,string>")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def shaped_findings(df: DataFrame, **columns) -> DataFrame:
    """Rows of ``df`` as findings; columns not given get their empty value."""
    empty = {
        "detail": F.lit(""), "url": F.lit(""), "element": F.lit(None), "evidence": evidence(), "screenshot": F.lit(None),
        "how_to_fix": F.lit(""), "occurrences": F.lit(1), "other_urls": F.array(),
    }
    out = {**empty, **{k: (v if isinstance(v, Column) else F.lit(v)) for k, v in columns.items()}}
    return df.select(*[out[k].cast(t).alias(k) for k, t in COLUMNS.items()])


def weight(severity) -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    w = None
    for i, name in enumerate(seeds.SEVERITY_ORDER):
        w = F.when(s == name, i) if w is None else w.when(s == name, i)
    return w.otherwise(seeds.UNKNOWN_SEVERITY)


def finding_id() -> Column:
    raw = F.concat_ws("|", "category", "title", F.coalesce("url", F.lit("")), F.coalesce("element", F.lit("")))
    return F.left(F.sha1(raw), F.lit(12))


def group_id() -> Column:
    return F.left(F.sha1(F.concat_ws("|", "category", "title")), F.lit(12))


OTHER_URLS = 25


def merge_findings(findings: DataFrame) -> DataFrame:
    """One row per (category, title): the first finding, all occurrences, the first
    screenshot, and up to 25 other addresses in order of appearance.

    A site-wide problem can make one group a third of all rows, so addresses are
    first made distinct per group on (category, title, url), and the ranked window
    keeps, before its shuffle, only as many as can still matter: 25 to show, 24 the
    first finding may list itself, and its own address. The distinct addresses are written,
    as two steps read them: the findings are worked out once.
    """
    key = ["category", "title"]
    rest = [c for c in COLUMNS if c not in key]
    per_url = findings.groupBy(*key, "url").agg(
        F.min("seq").alias("first"),
        F.sum("occurrences").alias("n"),
        F.min_by(F.struct(*rest), "seq").alias("f"),
        F.min_by("screenshot", F.when(F.col("screenshot") != "", F.col("seq"))).alias("shot"),
        F.min(F.when(F.col("screenshot") != "", F.col("seq"))).alias("shot_at"),
    )
    per_url = cut_lineage(per_url, "findings")
    head = per_url.groupBy(*key).agg(
        F.min_by("f", "first").alias("f"), F.sum("n").alias("n"), F.min_by("shot", "shot_at").alias("shot")
    )
    w = Window.partitionBy(*key).orderBy("first")
    near = (
        per_url.where("url <> ''")
        .select(*key, "url", "first", F.row_number().over(w).alias("place"))
        .where(F.col("place") <= 2 * OTHER_URLS)
        .groupBy(*key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("urls"))
    )
    own = F.coalesce("f.other_urls", F.array().cast("array<string>"))
    more = F.array_except(F.coalesce("urls", F.array().cast("array<string>")), F.concat(own, F.array("f.url")))
    room = F.greatest(F.lit(OTHER_URLS) - F.size(own), F.lit(0))
    joined = head.join(near, key, "left")
    cols = {c: F.col(f"f.{c}") for c in rest}
    cols["occurrences"] = F.col("n")
    cols["screenshot"] = F.coalesce("shot", "f.screenshot")
    cols["other_urls"] = F.concat(own, F.slice(more, F.lit(1), room))
    return joined.select(*[(F.col(c) if c in key else cols[c]).alias(c) for c in COLUMNS])


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(weight("severity"), F.desc("occurrences"), "category", "seq")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, by category and in total, from one pass."""
    return findings.groupingSets([["severity"], ["category"], []], "severity", "category").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n")
    ).select(
        F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "category").otherwise("total").alias("kind"),
        F.coalesce("severity", "category", F.lit("")).alias("value"),
        "n",
    )


def run_meta(pages: DataFrame, links_checked: DataFrame) -> DataFrame:
    """Totals of a run: pages tested, links checked, controls clicked, forms tested."""
    zero = F.lit(0)
    p = pages.select(F.lit(1).alias("pages_tested"), zero.alias("links_checked"), F.col("buttons_clicked").alias("controls_clicked"), "forms_tested")
    k = links_checked.select(zero.alias("pages_tested"), F.lit(1).alias("links_checked"), zero.alias("controls_clicked"), zero.alias("forms_tested"))
    return p.unionByName(k).agg(*[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in p.columns])


def fails(findings: DataFrame, severity: str) -> bool:
    """Any finding at least this severe?"""
    limit = seeds.SEVERITY_ORDER.index(severity)
    return not findings.where(weight("severity") <= limit).isEmpty()


def search(
    findings: DataFrame, severity: str | None = None, category: str | None = None, q: str = "", sort: str = "severity"
) -> DataFrame:
    """Filter and sort: ``q`` is looked for in all of a finding's texts, whole. What is found is written
    first: a sort reads its rows twice, the first time for its ranges."""
    rows = findings
    if severity:
        rows = rows.where(F.col("severity") == severity)
    if category:
        rows = rows.where(F.col("category") == category)
    if q.strip():
        blob = F.lower(F.concat_ws(" ", "title", "detail", "category", "url", F.coalesce("element", F.lit("")), F.to_json("evidence")))
        rows = rows.where(blob.contains(q.lower().strip()))
    orders = {
        "severity": [weight("severity"), F.desc("occurrences"), F.col("seq")],
        "count": [F.desc("occurrences"), F.col("seq")],
        "category": [F.col("category"), weight("severity"), F.col("seq")],
    }
    return cut_lineage(rows, "found").orderBy(*orders[sort])


def most_urgent(findings: DataFrame, k: int = 12) -> DataFrame:
    return order_findings(findings.where(F.col("severity").isin("critical", "high"))).limit(k)


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def page_results(pages: DataFrame, findings: DataFrame, links: DataFrame) -> DataFrame:
    """Per page: links found and findings. ``pages`` has url; ``links`` has page_url and
    its resolved target; the counts meet as rows of one aggregate."""
    rows = (
        pages.select("url", F.lit(1).alias("page"), F.lit(0).alias("f"), F.lit(0).alias("l"))
        .unionByName(findings.select("url", F.lit(0).alias("page"), F.lit(1).alias("f"), F.lit(0).alias("l")))
        .unionByName(
            links.where("target IS NOT NULL").select(F.col("page_url").alias("url"), F.lit(0).alias("page"), F.lit(0).alias("f"), F.lit(1).alias("l"))
        )
    )
    return (
        rows.groupBy("url")
        .agg(F.max("page").alias("page"), F.sum("l").alias("links_found"), F.sum("f").alias("findings"))
        .where("page = 1")
        .drop("page")
    )
