"""URL filters with redirect equivalence, in DataFrame operations only.

Rules fit a host and its subdomains where the path starts with the rule's; the longest
rule wins. A url with a rule keeps that verdict. Urls that redirect to each other or name
one canonical address are aliases: connected components over these edges, found by
randomised contraction, carry a block decision to all aliases without a rule of their own.
Explicit allow takes precedence: a component with an allowed member blocks nobody.

Edges come from the captured page: a refresh redirect, a canonical link and an Open Graph
address name the page's target, resolved against its url; and every url is tied to its own
normal form (scheme, ``www.`` and ``m.`` prefix, fragment, tracking and session
parameters, default file name and closing slash left out), which servers redirect to.
The addresses are hashed to 64-bit nodes; only addresses that two urls share make edges.

Rules are joined by (host suffix, path prefix length) keys, so any number of rules costs one
equality join per level of a host, and a url meets each rule that fits it once.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and no
alias; a null html gives no link; equal urls are aliases; rows are judged one by one;
conflicting rules of one host and path: allow wins; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.components import connected_components
from webloom.llm.stages import Stages
from webloom.session import broadcast_if_small

#: The rules of the query: host, path prefix, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not select a page.
TRACKING = "utm_[a-z]+|ref|source|fbclid|gclid|sid|sessionid|phpsessid"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """The address a server would redirect ``url`` to, without its scheme."""
    host = F.regexp_replace(host_of(url), "^(?:www|m|amp)\\.", "")
    path = F.regexp_replace(path_of(url), "(?:/(?:index|default)\\.[a-z]{3,5})?/*$", "")
    query = F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{TRACKING})(?:=|$)")))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


TAG = "(?is)<(?:meta|link)\\b[^>]*>"


def attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, f"(?is)\\s{name}\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)", 1)
    return F.trim(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def page_targets(html: Column) -> Column:
    """Array of the addresses that a page names as its own."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAG), 0), lambda t: t.rlike("(?i)canonical|refresh|og:url"))

    def target(t: Column) -> Column:
        link = F.when(F.lower(attribute(t, "rel")) == "canonical", attribute(t, "href"))
        refresh = F.when(F.lower(attribute(t, "http-equiv")) == "refresh", F.trim(F.regexp_extract(attribute(t, "content"), "(?is)url\\s*=\\s*['\"]?([^'\"]*)", 1)))
        graph = F.when(F.lower(attribute(t, "property")) == "og:url", attribute(t, "content"))
        return F.coalesce(link, refresh, graph)

    return F.filter(F.transform(tags, target), lambda t: t.isNotNull() & (t != ""))


def absolute(target: Column, url: Column) -> Column:
    """A target as a full address."""
    scheme = F.regexp_extract(url, "^(.*?)://", 1)
    base = F.concat(scheme, F.lit("://"), host_of(url))
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.regexp_replace(path_of(url), "[^/]*$", ""), F.when(path_of(url) == "", "/").otherwise(""), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target): redirect and canonical edges of captured pages, as addresses."""
    own = pages.where(F.col("url").contains("://"))
    linked = own.select("url", F.explode(page_targets(F.col("html"))).alias("t"))
    return linked.select("url", absolute(F.col("t"), F.col("url")).alias("target"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (row, host, path) that a rule fits: row, rule, rule_verdict of the longest one.
    The longest is the one with the longest host, then the longest path."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = rules.select(F.col("rule_host").alias("h"), F.length("rule_path").alias("n")).distinct()
    wide = urls.where("host <> ''").select("row", "path", F.explode(suffixes).alias("h"))
    probes = wide.join(broadcast_if_small(lengths), "h").where(F.length("path") >= F.col("n"))
    probes = probes.select("row", F.col("h").alias("rule_host"), F.expr("left(path, n)").alias("rule_path"))
    hits = probes.join(broadcast_if_small(rules), ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("m"), (F.col("rule_verdict") == "allow").alias("a"), rule.alias("rule"), F.col("rule_verdict").alias("v"))
    best = hits.groupBy("row").agg(F.max(rank).alias("best"))
    return best.select("row", F.col("best.rule").alias("rule"), F.col("best.v").alias("rule_verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, and
    ``by``: what decided (rule, alias or default). ``edges`` (url, target) adds known redirects."""
    stages = Stages(pages.sparkSession, "urls")
    url = F.col("url")
    form = normal_form(url)
    targets = F.transform(page_targets(F.col("html")), lambda t: F.coalesce(normal_form(absolute(t, url)), t))
    rows = pages.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(form).alias("node"), form.isNull().alias("lost"),
        F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda t: F.xxhash64(t)).alias("targets"))
    rows = stages.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    known = rows.where(~F.col("lost"))
    links = known.select(F.col("node").alias("a"), F.explode("targets").alias("b"))
    if edges is not None:
        links = links.unionByName(edges.select(F.xxhash64(normal_form(F.col("url"))).alias("a"), F.xxhash64(normal_form(F.col("target"))).alias("b")))
    roots = connected_components(links, stages)

    fits = with_rules(rows.select("row", "host", "path"), rules)
    judged = stages.write(rows.join(fits, "row", "left").select("row", "page_id", "host", "path", "rule", "rule_verdict", "lost", "node"), "judged")
    placed = judged.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stages.write(placed, "placed")
    said = placed.where("rule is not null and not lost").groupBy("root").agg(
        F.max((F.col("rule_verdict") == "block").cast("int")).alias("blocked"), F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allowed"))
    said = said.where("blocked = 1 and allowed = 0").select("root", F.lit(True).alias("alias_block"))
    out = placed.join(said, "root", "left")
    through = F.col("rule").isNull() & ~F.col("lost") & F.coalesce("alias_block", F.lit(False))
    verdict = F.when(F.col("rule").isNotNull(), F.col("rule_verdict")).when(through, "block").otherwise("allow")
    by = F.when(F.col("rule").isNotNull(), "rule").when(through, "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("by"))
