"""Technologies behind a site: fingerprint match, implied ones, categories, hosting,
and saved answers of authority and page-speed services.

Fingerprints are a table (tech, field, key, pattern); fields are header, cookie,
script_src, script, meta, js, url, html.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import urls as U
from webloom.functions.literals import PatternBook
from webloom.session import broadcast_if_small, cut_lineage

#: patterns that one pass over the pages tests; a larger book takes several passes
BLOCK = 20_000
KEYED = ["header", "cookie", "meta", "js"]
FREE = ["url", "script_src", "script", "html"]


def clean_pattern(pattern: Column) -> Column:
    """The regex part of a fingerprint: cut at a backslash-semicolon, empty means anything."""
    raw = F.split_part(F.coalesce(pattern, F.lit("")), F.lit("\\;"), F.lit(1))
    return F.when(raw == "", ".*").otherwise(raw)


@lru_cache(maxsize=BLOCK)
def _regex(pattern: str) -> re.Pattern:
    """The pattern, case-blind; a broken one is taken literally."""
    try:
        return re.compile(pattern, re.IGNORECASE)
    except re.error:
        return re.compile(re.escape(pattern), re.IGNORECASE)


def fingerprint_book(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints that can be tested (tech, field, key, p, any), without repeats."""
    fp = fingerprints.select("tech", "field", F.coalesce("key", F.lit("")).alias("key"), clean_pattern(F.col("pattern")).alias("p"),
                             (F.coalesce("pattern", F.lit("")) == "").alias("any"))
    return fp.where((F.col("field") != "js") | (~F.col("key").rlike(r"[.\[\]]") & (F.length("key") >= 4))).distinct()


def harvest_facts(harvest: DataFrame) -> DataFrame:
    """What fingerprints with a key can look at: (page_id, field, key, value)."""
    lower = lambda m: F.transform_keys(F.coalesce(F.col(m), F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))), lambda k, v: F.lower(k))
    pair = lambda f, k, v: F.struct(F.lit(f).alias("field"), k.alias("key"), v.alias("value"))
    no = F.array().cast("array<string>")
    items = F.concat(
        F.transform(F.map_entries(lower("headers")), lambda e: pair("header", e["key"], F.coalesce(e["value"], F.lit("")))),
        F.transform(F.map_entries(lower("meta")), lambda e: pair("meta", e["key"], F.coalesce(e["value"], F.lit("")))),
        F.transform(
            F.filter(F.split(F.coalesce("cookies", F.lit("")), ";"), lambda c: c.contains("=")),
            lambda c: pair("cookie", F.trim(F.split_part(c, F.lit("="), F.lit(1))), F.regexp_extract(c, "(?s)^[^=]*=(.*)$", 1)),
        ),
        F.transform(F.coalesce("globals", no), lambda s: pair("js", s, F.lit(""))),
    )
    return harvest.select("page_id", F.explode(items).alias("i")).select("page_id", "i.*")


def _matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (page_id, tech, value, p) whose pattern is found in the value."""
    for rows in batches:
        hit = [_regex(p).search(v) is not None for p, v in zip(rows["p"], rows["value"], strict=True)]
        yield rows.loc[hit, ["page_id", "tech"]]


def _searches(book):
    """Tests each pattern of ``book`` (field, tech, pattern) by itself on every page that holds its literal."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = {f: PatternBook((tech, p) for field, tech, p in book.value if field == f) for f in FREE}
        fields = [f for f in FREE if books[f].named]  # html, the longest, comes last
        for rows in batches:
            pages, techs = [], []
            for page_id, *values in zip(rows["page_id"], *(rows[f] for f in fields), strict=True):
                found: set[str] = set()
                for field, texts in zip(fields, values, strict=True):
                    for text in [texts] if isinstance(texts, str) else (() if texts is None else texts):
                        if text is not None:
                            found |= books[field].found(text, found)
                pages += [page_id] * len(found)
                techs += found
            yield pd.DataFrame({"page_id": pd.Series(pages, dtype=rows["page_id"].dtype), "tech": pd.Series(techs, dtype=object)})

    return task


def detect_tech(harvest: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(page_id, tech) by direct evidence. Fields with a key (headers, cookies, meta,
    globals) meet the fingerprints on (field, key). The others are searched pattern by
    pattern in the page's own row, in Arrow batches: an automaton of the patterns' literals tells
    which of them a page can match at all. Books of any size: ``BLOCK`` patterns travel with one pass over the pages."""
    spark = harvest.sparkSession
    book = cut_lineage(fingerprint_book(fingerprints), "fingerprints")
    keyed = book.where(F.col("field").isin(*KEYED)).withColumn(
        "key", F.when(F.col("field").isin("header", "meta"), F.lower("key")).otherwise(F.col("key"))
    )
    pair = f"page_id {harvest.schema['page_id'].dataType.simpleString()}, tech string"
    met = harvest_facts(harvest).join(broadcast_if_small(keyed), ["field", "key"])
    sure = (F.col("field") == "js") | F.col("any")
    found = met.where(sure).select("page_id", "tech")
    tested = met.where(~sure & F.col("value").isNotNull()).select("page_id", "tech", "value", "p")
    found = found.unionByName(tested.mapInPandas(_matches, pair))
    free = book.where(F.col("field").isin(*FREE)).select("field", "tech", "p").distinct()
    blocks = -(-free.count() // BLOCK)
    free = free.withColumn("block", F.pmod(F.xxhash64("tech", "p"), F.lit(max(blocks, 1))))
    pages = harvest.select("page_id", "url", "script_src", F.col("scripts").alias("script"), "html")
    for block in range(blocks):
        part = spark.sparkContext.broadcast([tuple(r) for r in free.where(F.col("block") == block).select("field", "tech", "p").collect()])
        found = found.unionByName(pages.mapInPandas(_searches(part), pair))
    return found.distinct()


def implied(found: DataFrame, implies: DataFrame, known: DataFrame, key: str = "page_id") -> DataFrame:
    """Technologies found, and all they imply, step by step. ``implies``: tech,
    implied; ``known``: tech. The closure of the (small) table is built first, so the
    pages are joined once, with a list for each technology, and read once."""
    step = implies.select("tech", F.split_part("implied", F.lit("\\;"), F.lit(1)).alias("implied"))
    step = step.where("implied <> '' AND implied <> tech").join(known.select(F.col("tech").alias("implied")), "implied", "left_semi")
    step = step.select("tech", "implied").distinct()
    closure = cut_lineage(step, "implies")
    size = closure.count()
    while True:
        grown = closure.unionByName(
            closure.select("tech", F.col("implied").alias("via")).join(step.withColumnRenamed("tech", "via"), "via").select("tech", "implied")
        ).distinct()
        closure = cut_lineage(grown, "implies")
        now = closure.count()
        if now == size:
            break
        size = now
    all_of = closure.groupBy("tech").agg(F.collect_set("implied").alias("implied"))
    more = F.coalesce("implied", F.array().cast("array<string>"))
    return found.join(all_of, "tech", "left").select(key, F.explode(F.concat(F.array("tech"), more)).alias("tech")).distinct()


def tech_categories(found: DataFrame, cats: DataFrame, names: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, tech, category): the first category of each, Other without one."""
    first = cats.join(names, "cat_id", "left").groupBy("tech").agg(F.min_by(F.coalesce("name", F.lit("")), "pos").alias("category"))
    return found.join(first, "tech", "left").select(key, "tech", F.coalesce("category", F.lit("Other")).alias("category"))


def tech_display(categorised: DataFrame, key: str = "page_id", categories: int | None = None, names: int | None = None) -> DataFrame:
    """The categories shown for each page, by priority, then name, and their technologies;
    ``categories`` and ``names`` show the first ones only."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in seeds.TECH_CATEGORY_PRIORITY]), F.col("category")), F.lit(0))
    rank = F.when(rank == 0, 100).otherwise(rank)
    groups = categorised.groupBy(key, "category").agg(F.array_sort(F.collect_set("tech")).alias("techs"))
    w = Window.partitionBy(key).orderBy(rank, "category")
    rows = groups.withColumn("place", F.row_number().over(w))
    if categories is not None:
        rows = rows.where(F.col("place") <= categories)
    return rows.select(key, "place", "category", (F.col("techs") if names is None else F.slice("techs", 1, names)).alias("techs"))


def hosting(df: DataFrame, url: str = "url", headers: str = "headers") -> DataFrame:
    """host, scheme, server, powered_by, cdn from the answer's headers. Row-wise."""
    h = F.transform_keys(headers, lambda k, v: F.lower(k))
    blob = F.lower(F.array_join(F.transform(F.map_entries(h), lambda e: F.concat_ws(":", e["key"], e["value"])), " "))
    cdn = None
    for needle, label in seeds.CDN_NEEDLES:
        cdn = F.when(blob.contains(needle), label) if cdn is None else cdn.when(blob.contains(needle), label)
    get = lambda k: F.nullif(F.try_element_at(h, F.lit(k)), F.lit(""))
    return df.select(
        "*", F.split_part(U.netloc_of(url), F.lit(":"), F.lit(1)).alias("host"), U.scheme_of(url).alias("scheme"),
        get("server").alias("server"), get("x-powered-by").alias("powered_by"), cdn.alias("cdn"),
    )


def parse_authority(df: DataFrame, column: str = "body") -> DataFrame:
    """Saved answers of an authority service: found, score (2 places), rank, available."""
    j = F.from_json(F.col(column), "response array<struct<status_code:int,page_rank_decimal:string,rank:string>>")
    row = F.get(j["response"], 0)
    ok = row["status_code"] == 200
    return df.select(
        "*", row.isNotNull().alias("available"), F.coalesce(ok, F.lit(False)).alias("found"),
        F.when(ok, F.bround(F.coalesce(row["page_rank_decimal"].try_cast("double"), F.lit(0.0)), 2)).alias("score"),
        F.when(ok, row["rank"]).alias("rank"),
    )


def rating(category: Column) -> Column:
    return F.when(category == "FAST", "good").when(category == "AVERAGE", "average").when(category == "SLOW", "poor").otherwise("—")


def milliseconds(value: Column) -> Column:
    v = value.try_cast("double")
    return F.when(v.isNull(), "—").when(v >= 1000, F.format_string("%.2f s", v / 1000)).otherwise(F.format_string("%.0f ms", v))


def parse_page_speed(df: DataFrame, column: str = "body") -> DataFrame:
    """Saved page-speed answers: available, reason, lab_score, lab and field maps, overall."""
    audit = "map<string,struct<displayValue:string>>"
    metric = "map<string,struct<percentile:double,category:string>>"
    schema = (
        f"error struct<message:string>, lighthouseResult struct<categories:struct<performance:struct<score:double>>,audits:{audit}>, "
        f"loadingExperience struct<metrics:{metric},overall_category:string>"
    )
    j = F.from_json(F.col(column), schema)
    lab = F.filter(
        F.array(*[F.struct(F.lit(s).alias("k"), F.try_element_at(j["lighthouseResult"]["audits"], F.lit(k))["displayValue"].alias("v")) for k, s in seeds.LAB_METRICS]),
        lambda e: e["v"].isNotNull() & (e["v"] != ""),
    )
    field = F.filter(
        F.array(*[F.struct(F.lit(s).alias("k"), F.try_element_at(j["loadingExperience"]["metrics"], F.lit(k)).alias("v")) for k, s in seeds.FIELD_METRICS]),
        lambda e: e["v"].isNotNull(),
    )
    readable = j.isNotNull() & F.coalesce(F.col(column), F.lit("")).rlike(r"^\s*\{")
    return df.select(
        "*", (readable & j["error"].isNull()).alias("available"),
        F.when(~readable, "The page-speed service did not respond.").when(
            j["error"].isNotNull(), F.concat(F.lit("PageSpeed error: "), F.left(F.coalesce(j["error"]["message"], F.lit("")), F.lit(160)))
        ).alias("reason"),
        F.bround(j["lighthouseResult"]["categories"]["performance"]["score"] * 100).cast("int").alias("lab_score"),
        F.map_from_entries(lab).alias("lab"), F.map_from_entries(field).alias("field"),
        j["loadingExperience"]["overall_category"].alias("overall"),
    )
