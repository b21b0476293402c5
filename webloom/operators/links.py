"""Links of captured pages and the per-site link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions import urls as U
from webloom.functions.urls import let


def elements(pages: DataFrame) -> DataFrame:
    """Every tag of every page: page_id, pos, tag, is_close, attrs, inner text up
    to the next tag. Row-wise: no shuffle."""
    token = rf"(?is)</?[a-z]{H.ATTRS}>[^<]*"
    tag_part = rf"(?is)^</?[a-z]{H.ATTRS}>"
    base = pages.select("page_id", H.markup(F.col("html")).alias("m"))
    rows = base.select("page_id", F.posexplode(F.regexp_extract_all("m", F.lit(token), 0)).alias("pos", "t"))
    return rows.select(
        "page_id",
        "pos",
        H.tag_name(F.col("t")).alias("tag"),
        F.col("t").startswith("</").alias("is_close"),
        H.attrs(F.col("t")).alias("attrs"),
        H.plain(F.regexp_replace("t", tag_part, "")).alias("text"),
    )


def link_array(clean: Column) -> Column:
    """The links of one page: (href, text, rel), links without a target left out."""

    def one(chunk: Column) -> Column:
        return let(
            H.attrs(chunk),
            lambda a: F.struct(
                H.attr(a, "href").alias("href"),
                F.substring(
                    let(
                        H.text_of(H.inner(chunk)),
                        lambda t: F.when(t != "", t).otherwise(
                            F.coalesce(H.first_image_alt(H.inner(chunk)), F.lit(""))
                        ),
                    ),
                    1,
                    120,
                ).alias("text"),
                F.lower(F.coalesce(H.attr(a, "rel"), F.lit(""))).alias("rel"),
            ),
        )

    return F.filter(F.transform(H.blocks(clean, "a"), one), lambda x: x["href"].isNotNull() & (x["href"] != ""))


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per link: page_id, page_url, pos, href, text, rel."""
    base = pages.select("page_id", F.col("url").alias("page_url"), H.markup(F.col("html")).alias("m"))
    rows = base.select("page_id", "page_url", F.posexplode(link_array(F.col("m"))).alias("pos", "l"))
    return rows.select("page_id", "page_url", "pos", "l.href", "l.text", "l.rel")


def build_edges(links: DataFrame, base: Column | None = None, allow_subdomains: bool = False) -> DataFrame:
    """Edges source -> target; of equal (source, target) pairs the first one stays.

    ``base`` is the site's start URL; without one every page is judged against
    its own host. One shuffle on (source, target), combined on the map side.
    """
    own = U.normalise("page_url")
    ends = links.select(
        "page_id", "pos", "href", "text", "rel", F.coalesce(own, F.col("page_url")).alias("source")
    )
    ends = ends.withColumn("target", U.normalise("href", F.col("source"))).where("target IS NOT NULL")
    site = F.col("source") if base is None else base
    ends = ends.withColumn("internal", U.same_scope("target", site, allow_subdomains))
    order = F.struct("page_id", "pos")
    first = F.min_by(F.struct("text", "rel", "internal", "page_id", "pos"), order)
    edges = ends.groupBy("source", "target").agg(first.alias("f"))
    return edges.select(
        "source",
        "target",
        F.left(F.trim("f.text"), F.lit(120)).alias("anchor"),
        "f.internal",
        F.coalesce("f.rel", F.lit("")).contains("nofollow").alias("nofollow"),
        "f.page_id",
        "f.pos",
    )


def visited_pages(pages: DataFrame) -> DataFrame:
    """Distinct normal addresses of the pages that were captured."""
    return pages.select(U.normalise("url").alias("url")).where("url IS NOT NULL").distinct()


def inbound_counts(edges: DataFrame) -> DataFrame:
    """Followed internal links that point at each page."""
    return (
        edges.where("internal AND NOT nofollow")
        .groupBy(F.col("target").alias("url"))
        .agg(F.count("*").alias("inbound_internal"))
    )


def orphan_pages(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """Visited pages no followed internal link points at."""
    return visited.join(inbound_counts(edges), "url", "left_anti")


def top_pages(visited: DataFrame, ranks: DataFrame, edges: DataFrame, k: int = 25) -> DataFrame:
    """The k pages with most rank, then most inbound links, then by address."""
    joined = visited.join(ranks, "url", "left").join(inbound_counts(edges), "url", "left")
    return (
        joined.select(
            "url",
            U.path_of("url").alias("path"),
            F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"),
            F.coalesce("inbound_internal", F.lit(0)).cast("long").alias("inbound_internal"),
        )
        .orderBy(F.desc("pagerank"), F.desc("inbound_internal"), "url")
        .limit(k)
    )


def outbound_external(edges: DataFrame, k: int = 40, anchors: int = 5) -> DataFrame:
    """External domains the site links to, with the first few anchors of each.

    The anchor list is a ranked window, which Spark cuts to ``anchors`` rows per
    domain before the shuffle, so a hot domain stays small.
    """
    ext = edges.where("NOT internal").withColumn("domain", U.domain_of("target"))
    totals = (
        ext.groupBy("domain")
        .agg(
            F.count("*").alias("links"),
            F.count_distinct("source").alias("from_pages"),
            F.count_if("nofollow").alias("nofollow"),
        )
        .orderBy(F.desc("links"), "domain")
        .limit(k)
    )
    w = Window.partitionBy("domain").orderBy("page_id", "pos", "target")
    shown = (
        ext.where("anchor <> ''")
        .select("domain", "page_id", "pos", "target", "anchor", F.row_number().over(w).alias("n"))
        .where(F.col("n") <= anchors)
        .groupBy("domain")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "anchor"))), lambda x: x["anchor"]).alias("anchors"))
    )
    return (
        totals.join(shown, "domain", "left")
        .withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
        .orderBy(F.desc("links"), "domain")
    )


def top_anchors(edges: DataFrame, k: int = 20) -> DataFrame:
    text = F.trim(F.lower("anchor"))
    return (
        edges.select(text.alias("text"))
        .where("text <> ''")
        .groupBy("text")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "text")
        .limit(k)
    )


def graph_stats(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals; the page count travels as an extra row of the same aggregate."""
    e = edges.select(
        F.lit(0).alias("page"),
        F.lit(1).alias("edge"),
        F.col("internal").cast("int").alias("internal"),
        F.when(~F.col("internal"), U.domain_of("target")).alias("domain"),
        F.col("nofollow").cast("int").alias("nofollow"),
    )
    p = visited.select(
        F.lit(1).alias("page"), F.lit(0).alias("edge"), F.lit(0).alias("internal"),
        F.lit(None).cast("string").alias("domain"), F.lit(0).alias("nofollow"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return e.unionByName(p).agg(
        zero("page").alias("pages"),
        zero("edge").alias("edges"),
        zero("internal").alias("internal_edges"),
        zero(F.col("edge") - F.col("internal")).alias("external_edges"),
        F.count_distinct("domain").alias("external_domains"),
        zero("nofollow").alias("nofollow_edges"),
    )
