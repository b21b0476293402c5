"""Crawl rules over captured texts: robots files, sitemaps, offline runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import predicates as P
from webloom.functions import urls as U
from webloom.functions.urls import let


GROUP = "struct<agents:array<string>,rules:array<struct<allow:boolean,prefix:string>>,delay:double>"
FOLD = f"struct<phase:int,group:{GROUP},groups:array<{GROUP}>>"


def unescaped(text: Column) -> Column:
    """Percent escapes as the characters they stand for; broken ones stay."""
    whole = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), text)


def robots_groups(robots: DataFrame) -> DataFrame:
    """Groups of robots files (origin, status, body): origin, groups in file order.

    A group is a run of agent lines with the rules after them. An empty line ends a group
    that has rules and forgets agents without any. Each file is folded inside its own row.
    """
    lines = F.split(F.regexp_replace("body", r"\r\n?", "\n"), "\n")
    parsed = F.transform(
        lines,
        lambda s: let(
            F.trim(F.regexp_replace(s, r"(?s)#.*$", "")),
            lambda t: F.struct(
                (s == "").alias("blank"),
                F.lower(F.trim(F.regexp_extract(t, r"^([^:]*):", 1))).alias("key"),
                unescaped(F.trim(F.regexp_extract(t, r"^[^:]*:(.*)$", 1))).alias("value"),
            ),
        ),
    )
    fresh = F.from_json(F.lit('{"agents":[],"rules":[]}'), GROUP)
    make = lambda phase, group, groups: F.struct(F.lit(phase).alias("phase"), group.alias("group"), groups.alias("groups")).cast(FOLD)

    def changed(g: Column, agents=None, rules=None, delay=None) -> Column:
        parts = {"agents": agents, "rules": rules, "delay": delay}
        return F.struct(*[(g[k] if v is None else v).alias(k) for k, v in parts.items()]).cast(GROUP)

    def step(acc: Column, ln: Column) -> Column:
        g, closed = acc["group"], F.concat(acc["groups"], F.array(acc["group"]))
        agent = F.array(ln["value"])
        allow = (ln["key"] == "allow") | (ln["value"] == "")
        rule = F.array(F.struct(allow.alias("allow"), ln["value"].alias("prefix")))
        delay = F.when(ln["value"].rlike(r"^[0-9]+$"), ln["value"].try_cast("double")).otherwise(g["delay"])
        return (
            F.when(ln["blank"], make(0, fresh, F.when(acc["phase"] == 2, closed).otherwise(acc["groups"])))
            .when((ln["key"] == "user-agent") & (acc["phase"] == 2), make(1, changed(fresh, agents=agent), closed))
            .when(ln["key"] == "user-agent", make(1, changed(g, agents=F.concat(g["agents"], agent)), acc["groups"]))
            .when(acc["phase"] == 0, acc)
            .when(ln["key"].isin("allow", "disallow"), make(2, changed(g, rules=F.concat(g["rules"], rule)), acc["groups"]))
            .when(ln["key"] == "crawl-delay", make(2, changed(g, delay=delay), acc["groups"]))
            .when(ln["key"] == "request-rate", make(2, g, acc["groups"]))
            .otherwise(acc)
        )

    start = make(0, fresh, F.from_json(F.lit("[]"), f"array<{GROUP}>"))
    end = lambda acc: F.when(acc["phase"] == 2, F.concat(acc["groups"], F.array(acc["group"]))).otherwise(acc["groups"])
    readable = robots.where("status < 400 AND body IS NOT NULL")
    return readable.select("origin", F.aggregate(parsed, start, step, end).alias("groups"))


def group_for(token: str) -> Column:
    """The first group that names the agent, else the first for all agents."""
    everyone = lambda g: F.array_contains(g["agents"], "*")
    named = F.filter("groups", lambda g: ~everyone(g) & F.exists(g["agents"], lambda a: F.contains(F.lit(token), F.lower(a))))
    return F.coalesce(F.get(named, 0), F.get(F.filter("groups", everyone), 0))


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """(url, allowed, crawl_delay): for the named agent and for ``*`` the first rule in
    file order that starts the unescaped path decides; allowed if either allows. Without a
    readable file everything is allowed. A file's groups stay one row, joined on the origin."""
    token = agent.split("/")[0].lower()
    named, anyone = group_for(token), group_for("*")
    files = robots_groups(robots).groupBy("origin").agg(F.min("groups").alias("groups"))
    files = files.select(
        "origin", named["rules"].alias("named"), anyone["rules"].alias("anyone"),
        F.coalesce(F.nullif(named["delay"], F.lit(0.0)), anyone["delay"], F.lit(0.0)).alias("delay"),
    )
    p = pages.select("url").distinct().withColumn("origin", U.origin("url"))
    query = U.query_of("url")
    p = p.withColumn("path", unescaped(F.concat(U.path_of("url"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))))
    first = lambda rules: F.coalesce(F.get(F.filter(rules, lambda r: F.startswith("path", r["prefix"])), 0)["allow"], F.lit(True))
    return p.join(files, "origin", "left").select(
        "url", (first("named") | first("anyone")).alias("allowed"), F.coalesce("delay", F.lit(0.0)).alias("crawl_delay")
    )


def sitemap_refs(robots_text: Column, root: Column, limit: int | None = None) -> Column:
    """Sitemaps a robots text names, else the two usual places; with ``limit`` the first ones."""
    named = F.regexp_extract_all(F.coalesce(robots_text, F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)
    usual = F.array(F.concat(root, F.lit("/sitemap.xml")), F.concat(root, F.lit("/sitemap_index.xml")))
    every = F.when(F.size(named) > 0, named).otherwise(usual)
    return every if limit is None else F.slice(every, 1, limit)


LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"


def sitemap_urls(fetches: DataFrame, base: Column | None = None, nested: int | None = None, allow_subdomains: bool = False) -> DataFrame:
    """Page addresses of sitemaps, distinct, in order: (site, url, seq).

    ``fetches``: site, url, seq, status, body; rows with ``seq`` are sitemaps a site
    was asked for, the others may be nested ones (one level; with ``nested`` the first ones of each sitemap)."""
    readable = fetches.where((F.col("status") < 400) & F.col("body").rlike(r"(?i)<(urlset|sitemapindex)\b"))
    locs = readable.where("seq IS NOT NULL").select("site", "seq", F.posexplode(F.regexp_extract_all("body", F.lit(LOC), 1)).alias("pos", "loc"))
    inner = locs.where(F.lower("loc").endswith(".xml"))
    w = Window.partitionBy("site", "seq").orderBy("pos")
    inner = inner.withColumn("n", F.row_number().over(w))
    if nested is not None:
        inner = inner.where(F.col("n") <= nested)
    subs = fetches.where("status < 400").select(F.col("url").alias("loc"), F.col("body").alias("sub"))
    deep = inner.join(subs, "loc").select(
        "site", "seq", F.lit(1).alias("level"), F.col("n").alias("at"), F.posexplode(F.regexp_extract_all("sub", F.lit(LOC), 1)).alias("pos", "loc")
    )
    flat = locs.select("site", "seq", F.lit(0).alias("level"), F.lit(0).alias("at"), "pos", "loc").unionByName(deep)
    root = F.col("site") if base is None else base
    urls = flat.withColumn("url", U.normalise("loc")).where(
        F.col("url").isNotNull() & U.same_scope("url", root, allow_subdomains) & ~F.lower("url").endswith(".xml")
    )
    order = F.struct("seq", "level", "at", "pos")
    return urls.groupBy("site", "url").agg(F.min(order).alias("o")).select("site", "url", "o")


def offline_stops(results: DataFrame, streak: int = 3) -> DataFrame:
    """Where each run stops because the machine is offline: (run, stop_seq).

    ``results``: run, seq, failed, error. The stop is the row at which the streak of
    failures with offline errors gets long enough; anything else resets it. A run is
    cut into slots of ``seq`` so that no run is one task's work: rows are counted
    inside a slot, and slot totals tell how long a streak comes in from before.
    """
    off = F.coalesce(F.col("failed") & P.looks_offline(F.col("error")), F.lit(False))
    rows = results.select("run", "seq", off.alias("off"), F.floor(F.col("seq") / F.lit(SLOT_ROWS)).alias("slot"))
    w = Window.partitionBy("run", "slot").orderBy("seq")
    rows = rows.withColumn("n", F.row_number().over(w))
    rows = rows.withColumn("reset", F.max(F.when(~F.col("off"), F.col("n"))).over(w))
    slots = rows.groupBy("run", "slot").agg(
        (F.max("n") - F.coalesce(F.max("reset"), F.lit(0))).alias("tail"), F.max("reset").isNotNull().cast("int").alias("resets")
    )
    by_slot = Window.partitionBy("run").orderBy("slot")
    island = slots.withColumn("island", F.sum("resets").over(by_slot))
    held = island.withColumn("held", F.sum("tail").over(Window.partitionBy("run", "island").orderBy("slot")))
    carried = held.select("run", "slot", F.coalesce(F.lag("held").over(by_slot), F.lit(0)).alias("carried"))
    length = F.when(F.col("reset").isNull(), F.col("n") + F.col("carried")).otherwise(F.col("n") - F.col("reset"))
    hit = rows.join(carried, ["run", "slot"]).where(F.col("off") & (length == streak))
    return hit.groupBy("run").agg(F.min("seq").alias("stop_seq"))


#: width of a slot of results, in units of ``seq``
SLOT_ROWS = 1_000
