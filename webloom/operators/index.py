"""The multi-site link index: merge jobs and read queries over its tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import urls as U
from webloom.session import cut_lineage

EDGE_COLUMNS = [
    "source_url", "target_url", "source_domain", "target_domain", "anchor", "internal", "nofollow",
    "first_seen", "last_seen",
]
DOMAIN_SCHEMA = (
    "domain string, first_seen long, last_seen long, crawled int, attempts int, last_error string, offtopic int"
)


def _flag(c) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")


# ------------------------------------------------------------------ merges
#: Rows of a batch that are edges.
COMPLETE = "source IS NOT NULL AND source <> '' AND target IS NOT NULL AND target <> ''"


def shape_batch(batch: DataFrame, now: int) -> DataFrame:
    """A batch of edges (source, target, anchor, internal, nofollow, seq) as index rows without domains."""
    return batch.where(COMPLETE).select(
        F.col("source").alias("source_url"),
        F.col("target").alias("target_url"),
        F.left(F.coalesce("anchor", F.lit("")), F.lit(200)).alias("anchor"),
        _flag("internal").alias("internal"),
        _flag("nofollow").alias("nofollow"),
        F.lit(now).cast("long").alias("first_seen"),
        F.lit(now).cast("long").alias("last_seen"),
        F.struct(F.lit(1).alias("gen"), F.col("seq").cast("long").alias("seq")).alias("at"),
    )


def merge_edges(index: DataFrame, batch: DataFrame, now: int, placed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The index after a batch, with ``is_new``. A known pair keeps its domains,
    internal flag and first_seen; anchor, nofollow and last_seen come from the
    latest row. One shuffle on (source, target) and one sort after it: pairs seldom
    repeat, so combining them before the shuffle would only sort every row twice.
    ``placed`` shuffles the rows by columns ``part`` and ``turn`` of its own, which
    follow from the pair and stay in the result."""
    stored = index.select(*EDGE_COLUMNS, F.struct(F.lit(0).alias("gen"), F.lit(0).cast("long").alias("seq")).alias("at"))
    fresh = shape_batch(batch, now)
    rows = stored.unionByName(fresh, allowMissingColumns=True)
    first = F.min_by(F.struct("source_domain", "target_domain", "internal", "first_seen"), "at")
    last = F.max_by(F.struct("anchor", "nofollow", "last_seen"), "at")
    place = [] if placed is None else ["part", "turn"]
    rows = rows.repartition("source_url", "target_url") if placed is None else placed(rows)
    merged = rows.groupBy(*place, "source_url", "target_url").agg(
        first.alias("f"), last.alias("l"), (F.min("at.gen") == 1).alias("is_new")
    )
    # a domain follows from its address: new pairs get theirs here, once per pair
    domain = lambda end: F.coalesce(F.col(f"f.{end}_domain"), U.domain_of(f"{end}_url")).alias(f"{end}_domain")
    return merged.select(
        "source_url", "target_url", domain("source"), domain("target"), "l.anchor", "f.internal", "l.nofollow",
        "f.first_seen", "l.last_seen", "is_new", *place,
    )


def new_edges(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if("is_new").alias("new_edges"))


def align_domains(domains: DataFrame) -> DataFrame:
    """Domain rows written before a column existed get its default."""
    defaults = {"crawled": F.lit(0), "attempts": F.lit(0), "offtopic": F.lit(0)}
    have = set(domains.columns)
    out = []
    for field in DOMAIN_SCHEMA.split(", "):
        name, kind = field.split(" ")
        col = F.col(name) if name in have else F.lit(None)
        out.append((F.coalesce(col.cast(kind), defaults[name]) if name in defaults else col.cast(kind)).alias(name))
    return domains.select(*out)


def _merge_domain_rows(rows: DataFrame) -> DataFrame:
    """Fold rows (domain, seen span, status marks, error with its time) per domain."""
    return rows.groupBy("domain").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("crawled").alias("crawled"),
        F.sum("attempts").cast("int").alias("attempts"),
        F.max_by("last_error", "error_at").alias("last_error"),
        F.max("offtopic").alias("offtopic"),
    )


def _stored_domains(domains: DataFrame) -> DataFrame:
    kept = F.when(F.col("last_error").isNotNull(), F.struct(F.lit(0).alias("gen"), F.lit(0).cast("long").alias("seq")))
    return align_domains(domains).withColumn("error_at", kept)


def batch_addresses(batch: DataFrame) -> DataFrame:
    """The distinct addresses at either end of a batch's edges: url, domain, is_source. The
    addresses are combined on the map side; a domain is derived once per address, not per link."""
    end = lambda c, source: F.struct(F.col(c).alias("url"), F.lit(source).alias("is_source"))
    ends = batch.where(COMPLETE).select(F.explode(F.array(end("source", True), end("target", False))).alias("e")).select("e.*")
    return ends.groupBy("url").agg(F.max("is_source").alias("is_source")).select("url", U.domain_of("url").alias("domain"), "is_source")


def merge_domains(domains: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """Both ends of every edge of the batch are known domains afterwards."""
    return add_domains(domains, batch_addresses(batch), now)


def add_domains(domains: DataFrame, addresses: DataFrame, now: int) -> DataFrame:
    """The domains of the addresses are known afterwards."""
    seen = F.lit(now).cast("long")
    touched = align_domains(addresses.select("domain", seen.alias("first_seen"), seen.alias("last_seen"))).withColumn(
        "error_at", F.lit(None).cast("struct<gen:int,seq:long>"))
    return _merge_domain_rows(_stored_domains(domains).unionByName(touched))


def merge_pages(pages: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """Only pages that links were found on are kept."""
    return add_pages(pages, batch_addresses(batch), now)


def add_pages(pages: DataFrame, addresses: DataFrame, now: int) -> DataFrame:
    """The addresses that links were found on are known pages afterwards."""
    seen = F.lit(now).cast("long")
    found = addresses.where("is_source").select("url", "domain", seen.alias("first_seen"), seen.alias("last_seen"))
    rows = pages.select("url", "domain", "first_seen", "last_seen", F.lit(0).alias("gen"))
    rows = rows.unionByName(found.withColumn("gen", F.lit(1)))
    return rows.groupBy("url").agg(
        F.min_by("domain", "gen").alias("domain"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def classify_crawl(results: DataFrame) -> DataFrame:
    """Crawl result (domain, off_topic, pages, error, seq, now) -> status event."""
    status = F.when(F.col("off_topic"), "offtopic").when(F.col("pages") > 0, "crawled").otherwise("failed")
    return results.select("domain", status.alias("status"), F.coalesce("error", F.lit("")).alias("error"), "seq", "now")


def fold_domain_status(domains: DataFrame, events: DataFrame) -> DataFrame:
    """Domain rows after status events (domain, status, error, seq, now). Marks only
    ever rise; failures add up; the last failure's message stays."""
    failed = F.col("status") == "failed"
    at = F.struct(F.lit(1).alias("gen"), F.col("seq").cast("long").alias("seq"))
    rows = events.select(
        "domain",
        F.col("now").cast("long").alias("first_seen"),
        F.col("now").cast("long").alias("last_seen"),
        (F.col("status") == "crawled").cast("int").alias("crawled"),
        failed.cast("int").alias("attempts"),
        F.when(failed, F.left("error", F.lit(300))).alias("last_error"),
        (F.col("status") == "offtopic").cast("int").alias("offtopic"),
        F.when(failed, at).alias("error_at"),
    )
    return _merge_domain_rows(_stored_domains(domains).unionByName(rows))


def merge_meta(meta: DataFrame, updates: DataFrame) -> DataFrame:
    """Key/value upsert; of several updates of a key the last (by seq) stays."""
    rows = meta.select("key", "value", F.lit(-1).cast("long").alias("seq"))
    rows = rows.unionByName(updates.select("key", "value", F.col("seq").cast("long")))
    return rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def get_meta(meta: DataFrame, key: str, default: str = "") -> str:
    row = meta.where(F.col("key") == key).select("value").first()
    return row[0] if row else default


# ------------------------------------------------------------------ reads
def _crossing(edges: DataFrame) -> DataFrame:
    return edges.where("source_domain <> target_domain")


def domain_edges(edges: DataFrame, follow_only: bool = True) -> DataFrame:
    """External domain pairs with the number of distinct linking pages."""
    rows = _crossing(edges).where("internal = 0")
    if follow_only:
        rows = rows.where("nofollow = 0")
    return rows.groupBy("source_domain", "target_domain").agg(F.count_distinct("source_url").alias("weight"))


def domain_counts(edges: DataFrame) -> DataFrame:
    """Referring domains and backlinks per domain (nofollow and any internal flag included)."""
    per_pair = _crossing(edges).groupBy("target_domain", "source_domain").agg(F.count("*").alias("links"))
    return per_pair.groupBy(F.col("target_domain").alias("domain")).agg(
        F.count("*").alias("referring_domains"), F.sum("links").alias("backlinks")
    )


def backlinks(edges: DataFrame, domain: str, limit: int = 200) -> DataFrame:
    return (
        _crossing(edges)
        .where(F.col("target_domain") == domain)
        .select(
            F.col("source_url").alias("from_url"), F.col("source_domain").alias("from_domain"),
            F.col("target_url").alias("to_url"), "anchor", (F.col("nofollow") == 1).alias("nofollow"), "last_seen",
        )
        .orderBy("nofollow", F.desc("last_seen"), "from_url", "to_url")
        .limit(limit)
    )


def _referrers(edges: DataFrame) -> DataFrame:
    return _crossing(edges).groupBy("target_domain", "source_domain").agg(
        F.count_distinct("source_url").alias("links"), (F.min("nofollow") == 0).alias("follow")
    )


def referring_domains(edges: DataFrame, domain: str) -> DataFrame:
    return (
        _referrers(edges.where(F.col("target_domain") == domain))
        .select(F.col("source_domain").alias("domain"), "links", "follow")
        .orderBy(F.desc("links"), "domain")
    )


def outbound_domains(edges: DataFrame, domain: str) -> DataFrame:
    return (
        _referrers(edges.where(F.col("source_domain") == domain))
        .select(F.col("target_domain").alias("domain"), "links")
        .orderBy(F.desc("links"), "domain")
    )


def index_stats(domains: DataFrame, pages: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, from the three tables as rows of one aggregate."""
    one, zero = F.lit(1), F.lit(0)
    names = ["domains", "crawled_domains", "pages", "edges", "cross_domain_edges"]
    row = lambda *v: [x.cast("long").alias(n) for x, n in zip(v, names)]
    rows = (
        domains.select(*row(one, (F.col("crawled") == 1).cast("int"), zero, zero, zero))
        .unionByName(pages.select(*row(zero, zero, one, zero, zero)))
        .unionByName(edges.select(*row(zero, zero, zero, one, (F.col("source_domain") != F.col("target_domain")).cast("int"))))
    )
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def _waiting(edges: DataFrame, domains: DataFrame, min_referring: int) -> DataFrame:
    """Linked domains nobody has crawled yet, with enough referring domains."""
    open_ = align_domains(domains).where(
        f"crawled = 0 AND attempts < {seeds.MAX_ATTEMPTS} AND offtopic = 0 AND domain <> ''"
    ).select("domain")
    pairs = edges.where("internal = 0").groupBy(F.col("target_domain").alias("domain"), "source_domain").agg(
        F.min("target_url").alias("url")
    )
    per = pairs.groupBy("domain").agg(F.count("source_domain").alias("refdoms"), F.min("url").alias("url"))
    return per.where(F.col("refdoms") >= min_referring).join(open_, "domain", "left_semi")


def frontier(
    edges: DataFrame, domains: DataFrame, limit: int = 20, min_referring: int = 1, skip: Iterable[str] = ()
) -> DataFrame:
    """The most referenced domains not crawled yet: domain, refdoms, url.

    Hosts everybody links to and ``skip`` stay out. The anchors that point at
    them are rows of ``frontier_anchors``: a domain may have any number.
    """
    blocked = seeds.UTILITY_DOMAINS + [s.strip().lower() for s in skip if s.strip()]
    return (
        _waiting(edges, domains, min_referring)
        .where(~F.col("domain").isin(*blocked))
        .orderBy(F.desc("refdoms"), "domain")
        .limit(limit)
    )


def frontier_anchors(edges: DataFrame, waiting: DataFrame) -> DataFrame:
    """Distinct anchor texts of the links to the waiting domains, with counts."""
    return (
        edges.where("internal = 0")
        .select(F.col("target_domain").alias("domain"), "anchor")
        .join(waiting.select("domain"), "domain", "left_semi")
        .groupBy("domain", "anchor")
        .agg(F.count("*").alias("links"))
    )


def frontier_size(edges: DataFrame, domains: DataFrame, min_referring: int = 1) -> DataFrame:
    return _waiting(edges, domains, min_referring).agg(F.count("*").alias("waiting"))


def expand(
    edges: DataFrame, domains: DataFrame, n: int, terms: list[str] = (), seeds_given: Iterable[str] = (),
    min_referring: int = 1, skip: Iterable[str] = (),
) -> DataFrame:
    """What a run would do with the first 4n waiting domains: domain, url, refdoms,
    verdict (take | given | infrastructure | topic | spare), best first. One hit
    of a topic term in the domain name or an anchor is enough."""
    from webloom.operators.topics import topic_hit_terms

    # at most 4n rows, written once: the edges are aggregated once, and read once more for the anchors
    found = cut_lineage(frontier(edges, domains, 4 * n, min_referring, skip), "waiting")
    texts = frontier_anchors(edges, found).select("domain", F.concat_ws(" ", "domain", "anchor").alias("text"))
    texts = texts.unionByName(found.select("domain", F.col("domain").alias("text")))
    if terms:
        known = topic_hit_terms(F.col("text"), terms)
        on_topic = texts.where(F.size(known) > 0).select("domain").distinct().withColumn("on_topic", F.lit(True))
        found = found.join(on_topic, "domain", "left")
    else:
        found = found.withColumn("on_topic", F.lit(True))
    given = list(seeds_given)
    verdict = (
        F.when(F.col("domain").isin(*given), "given").when(U.is_infrastructure("domain"), "infrastructure")
        if given
        else F.when(U.is_infrastructure("domain"), "infrastructure")
    )
    verdict = verdict.when(F.col("on_topic").isNull(), "topic").otherwise("take")
    # at most 4n rows from here on
    w = Window.partitionBy("verdict").orderBy(F.desc("refdoms"), "domain")
    ranked = found.withColumn("verdict", verdict).withColumn("place", F.row_number().over(w))
    taken = (F.col("verdict") == "take") & (F.col("place") > n)
    marked = ranked.withColumn("verdict", F.when(taken, "spare").otherwise(F.col("verdict")))
    return marked.select("domain", "url", "refdoms", "verdict").orderBy(F.desc("refdoms"), "domain")


def scored_referrers(edges: DataFrame, leaderboard: DataFrame) -> DataFrame:
    """All referring domains of every domain: other, domain, links, follow, authority."""
    score = leaderboard.select(F.col("domain").alias("other"), "authority")
    pairs = _referrers(edges).select(F.col("target_domain").alias("domain"), F.col("source_domain").alias("other"), "links", "follow")
    return pairs.join(score, "other", "left").withColumn("authority", F.coalesce("authority", F.lit(0)))


def detail_lists(edges: DataFrame, leaderboard: DataFrame, k: int = 60) -> dict[str, DataFrame]:
    """Top-k lists of every domain at once: referring, backlinks, outbound. Ranked
    windows are cut to k rows per domain before the shuffle."""
    score = leaderboard.select(F.col("domain").alias("other"), "authority")

    def top(rows: DataFrame, key: str, *order) -> DataFrame:
        w = Window.partitionBy(key).orderBy(*order)
        return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

    pairs = _referrers(edges)
    scored = lambda rows: rows.join(score, "other", "left").withColumn("authority", F.coalesce("authority", F.lit(0)))
    referring = scored_referrers(edges, leaderboard)
    outbound = pairs.select(F.col("source_domain").alias("domain"), F.col("target_domain").alias("other"), "links")
    links = _crossing(edges).select(
        F.col("target_domain").alias("domain"), F.col("source_url").alias("from_url"),
        F.col("source_domain").alias("from_domain"), F.col("target_url").alias("to_url"), "anchor",
        (F.col("nofollow") == 1).alias("nofollow"), "last_seen",
    )
    return {
        "referring": top(referring, "domain", F.desc("authority"), F.desc("links"), "other"),
        "outbound": scored(top(outbound, "domain", F.desc("links"), "other")),
        "backlinks": top(links, "domain", "nofollow", F.desc("last_seen"), "from_url", "to_url"),
    }
