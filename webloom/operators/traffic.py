"""Findings from captured traffic: console, network, headers, probes, timings, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import predicates as P
from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.functions.html import collapse
from webloom.operators import findings as G


def _f(df, severity, category, title, **kw) -> DataFrame:
    kw.setdefault("seq", F.col("seq"))
    kw.setdefault("url", F.col("page_url"))
    return G.shaped_findings(df, severity=severity, category=F.lit(category) if isinstance(category, str) else category, title=title, **kw)


# ------------------------------------------------------------------ N1 - N4
def console_findings(console: DataFrame, page_errors: DataFrame) -> DataFrame:
    """Uncaught exceptions, console errors and notable warnings. Console lines of a
    page that begin with the same 120 characters count once, the first one."""
    errors = page_errors.where(~P.clipboard_refusal(F.col("message")))
    out = _f(
        errors, "critical", "JavaScript Error", F.concat(F.lit("Uncaught JS exception: "), F.left("message", F.lit(110))),
        evidence=G.evidence(message=F.col("message"), stack=F.coalesce("stack", F.lit(""))),
        detail="An exception nobody caught was thrown on this page.",
    )
    lines = (
        console.where(~P.ignorable_console(F.col("text")))
        .groupBy("page_url", F.left("text", F.lit(120)).alias("k"))
        .agg(F.min_by(F.struct("type", "text", "location", "seq"), "seq").alias("c"))
        .select("page_url", "c.*")
    )
    short = F.left("text", F.lit(110))
    loud = _f(lines.where("type = 'error'"), "high", "Console Error", F.concat(F.lit("console.error: "), short), evidence=G.evidence(text=F.col("text"), location=F.coalesce("location", F.lit(""))))
    noted = lines.where((F.col("type") == "warning") & F.col("text").rlike(seeds.NOTABLE_WARNING))
    return out.unionByName(loud).unionByName(_f(noted, "low", "Console Warning", F.concat(F.lit("console.warn: "), short), evidence=G.evidence(text=F.col("text"))))


def failed_requests(failed: DataFrame) -> DataFrame:
    """Requests the browser could not complete; aborted ones do not count."""
    rows = failed.where(~F.coalesce(F.col("failure"), F.lit("")).contains("ERR_ABORTED"))
    return _f(
        rows, "high", "Network", F.concat(F.lit("Request failed: "), U.shorten(F.col("url"), 80)),
        evidence=G.evidence(request_url=F.col("url"), resource_type=F.col("resource_type"), failure=F.coalesce("failure", F.lit("unknown")), method=F.col("method")),
        detail=F.concat(F.lit("The browser gave up: "), F.coalesce("failure", F.lit("unknown"))),
    )


def bad_responses(responses: DataFrame) -> DataFrame:
    """Error answers of a page, each (url, status) once, the first one."""
    rows = responses.where("status >= 400")
    keep = [c for c in rows.columns if c not in ("page_url", "url", "status")]
    first = rows.groupBy("page_url", "url", "status").agg(F.min_by(F.struct(*keep), "seq").alias("r"))
    return first.select("page_url", "url", "status", "r.*")


def network_findings(bad: DataFrame, page_text: DataFrame | None = None, logged_in: bool = False) -> DataFrame:
    """Grade error answers (``bad`` with body). A visitor's sign-in checks become one
    note per page; "nothing to show" answers are mild; the rest go by status. The whole
    body is judged; the texts shown are its first 300 characters."""
    rows = bad.withColumn("answer", X.redact_body(F.col("body"), None))
    if page_text is not None:
        shows = page_text.select("page_url", F.col("text").rlike(seeds.ERRORISH_PAGE).alias("shows_error"))
        rows = rows.join(shows, "page_url", "left")
    else:
        rows = rows.withColumn("shows_error", F.lit(False))
    rows = rows.withColumn("shows_error", F.coalesce("shows_error", F.lit(False)))
    probe = F.lit(False) if logged_in else P.is_auth_probe(F.col("resource_type"), F.col("status"), F.col("url"))
    rows = rows.withColumn("probe", probe)
    notes = rows.where("probe").groupBy("page_url").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("status").cast("string"))), "/").alias("codes"), F.min("seq").alias("seq")
    )
    out = _f(
        notes, "info", "Network", "Sign-in checks answer 'not signed in' (normal for visitors)", evidence=G.evidence(codes=F.col("codes")),
        detail=F.concat(F.lit("The server answers "), F.col("codes"), F.lit(" to a visitor, as expected.")),
    )
    rest = rows.where("NOT probe").withColumn("background", F.col("resource_type").isin("xhr", "fetch"))
    rest = rest.withColumn("is_empty", F.col("background") & P.is_empty_answer(F.col("status"), F.col("answer")))
    ev = G.evidence(request_url=F.col("url"), status=F.col("status"), method=F.col("method"), resource_type=F.col("resource_type"), response=F.left("answer", F.lit(300)))
    mild = _f(
        rest.where("is_empty"), F.when(F.col("shows_error"), "medium").otherwise("low"), "Network",
        F.concat(F.lit("API answers "), F.col("status"), F.lit(" for an empty result"), F.when(F.col("shows_error"), "").otherwise(" (the page shows no error)"), F.lit(": "), U.shorten(F.col("url"), 60)),
        evidence=ev, detail=F.left(X.answer_message(F.col("answer")), F.lit(300)),
    )
    sev = F.when(F.col("status") >= 500, "critical").when(F.col("status") == 429, "medium").otherwise("high")
    words = F.lit("the request did not succeed")
    for code, meaning in seeds.STATUS_MEANING.items():
        words = F.when(F.col("status") == code, meaning).otherwise(words)
    hard = _f(
        rest.where("NOT is_empty"), sev, "Network",
        F.concat(F.lit("HTTP "), F.col("status"), F.lit(" on "), F.coalesce("resource_type", F.lit("request")), F.lit(": "), U.shorten(F.col("url"), 70)),
        evidence=ev, detail=words,
    )
    return out.unionByName(mild).unionByName(hard)


# ------------------------------------------------------------------ N5 - N9
def http_findings(pages: DataFrame) -> DataFrame:
    rows = pages.where("status >= 400")
    return _f(rows, F.when(F.col("status") >= 500, "critical").otherwise("high"), "HTTP Status", F.concat(F.lit("Page returns HTTP "), F.col("status")), evidence=G.evidence(status=F.col("status")))


def header_findings(entry_pages: DataFrame) -> DataFrame:
    """Missing security headers and version banners of entry pages (page_url, seq,
    status, headers map). Row-wise over the five headers."""
    h = F.transform_keys("headers", lambda k, v: F.lower(k))
    rows = entry_pages.where("status IS NULL OR status < 400").withColumn("h", h)
    get = lambda k: F.coalesce(F.try_element_at("h", F.lit(k)), F.lit(""))
    framed = F.lower(get("content-security-policy")).contains("frame-ancestors")
    checks = []
    for key, label, severity in seeds.SECURITY_HEADERS:
        missing = ~F.map_contains_key("h", F.lit(key))
        if key == "strict-transport-security":
            missing = missing & F.col("page_url").startswith("https://")
        if key == "x-frame-options":
            missing = missing & ~framed
        checks.append(F.when(missing, F.struct(F.lit(severity).alias("severity"), F.lit(f"Missing security header: {label}").alias("title"))))
    banner = F.concat(get("server"), F.lit(" "), get("x-powered-by"))
    told = F.when(banner.rlike(r"\d+\.\d+"), F.struct(F.lit("info").alias("severity"), F.lit("Server software and version are advertised in response headers").alias("title")))
    hits = F.filter(F.array(*checks, told), lambda x: x.isNotNull())
    rows = rows.select("page_url", "seq", F.posexplode(hits).alias("pos", "x"))
    return _f(rows, F.col("x.severity"), "Security Headers", F.col("x.title"), seq=F.col("seq") * 10 + F.col("pos"))


def performance_findings(
    timings: DataFrame, slow_load_ms: int = seeds.SLOW_LOAD_MS, slow_ttfb_ms: int = seeds.SLOW_TTFB_MS, heavy_page_kb: int = seeds.HEAVY_PAGE_KB
) -> DataFrame:
    """Slow loads, slow first bytes, heavy pages (page_url, seq, load_ms, ttfb_ms,
    weight_kb, requests)."""
    row = lambda when, sev, title: F.when(when, F.struct(sev.alias("severity"), title.alias("title")))
    load, ttfb, kb = F.col("load_ms"), F.col("ttfb_ms"), F.col("weight_kb")
    fixed = lambda c, d: F.format_string(f"%.{d}f", c)
    checks = F.array(
        row(load > slow_load_ms, F.when(load < 2 * slow_load_ms, "medium").otherwise("high"), F.concat(F.lit("Slow page load: "), fixed(load / 1000, 1), F.lit("s"))),
        row(ttfb > slow_ttfb_ms, F.lit("medium"), F.concat(F.lit("Slow server response (TTFB "), fixed(ttfb, 0), F.lit(" ms)"))),
        row(kb > heavy_page_kb, F.lit("low"), F.concat(F.lit("Heavy page: "), fixed(kb / 1024, 1), F.lit(" MB transferred"))),
    )
    rows = timings.select("page_url", "seq", "requests", F.posexplode(F.filter(checks, lambda x: x.isNotNull())).alias("pos", "x"))
    return _f(rows, F.col("x.severity"), "Performance", F.col("x.title"), seq=F.col("seq") * 10 + F.col("pos"))


def page_weight(responses: DataFrame) -> DataFrame:
    return responses.groupBy("page_url").agg(
        (F.sum(F.coalesce("size", F.lit(0))) / 1024.0).alias("weight_kb"), F.count("*").alias("requests")
    )


def overflow_findings(metrics: DataFrame, elements: DataFrame | None = None, widest: int = 5) -> DataFrame:
    """Pages wider than their viewport that can be scrolled sideways. ``elements``: page_url, label,
    selector, right (where the element ends, in px); the ``widest`` of a page and label go with its finding. The
    ranked window keeps that many per group before the shuffle, however many elements a page has."""
    rows = metrics.where("NOT clipped AND scroll_width > width + 4")
    if elements is None:
        rows = rows.withColumn("wide", F.array().cast("array<struct<selector:string,right:long>>"))
    else:
        # addresses begin alike: a number in front of them decides nearly all comparisons of the sorts
        key = ["page", "page_url", "label"]
        elements, rows = (d.withColumn("page", F.xxhash64("page_url", "label")) for d in (elements, rows))
        order = Window.partitionBy(*key).orderBy(F.desc("right"), "selector")
        top = elements.withColumn("place", F.row_number().over(order)).where(F.col("place") <= widest)
        place = F.struct("place", "selector", F.col("right").cast("long").alias("right"))
        wide = F.transform(F.array_sort(F.collect_list(place)), lambda x: F.struct(x["selector"].alias("selector"), x["right"].alias("right")))
        rows = rows.join(top.groupBy(*key).agg(wide.alias("wide")), key, "left")
    first = F.get("wide", 0)
    culprit = F.when(first.isNotNull(), F.concat(F.lit("The element that reaches farthest, to "), first["right"], F.lit("px, is "), first["selector"], F.lit(".")))
    return _f(
        rows, "medium", "Responsive", F.concat(F.lit("Horizontal scrolling on "), F.col("label"), F.lit(" ("), F.col("width"), F.lit("px)")),
        detail=F.coalesce(culprit, F.lit("No single element was seen to reach beyond the viewport.")),
        evidence=G.evidence(
            viewport_width=F.col("width"), content_width=F.col("scroll_width"), overflow_px=F.col("scroll_width") - F.col("width"),
            widest_elements=F.to_json(F.coalesce("wide", F.array().cast("array<struct<selector:string,right:long>>")))),
    )


# ------------------------------------------------------------------ N10 - N13: site probes
def effective_probe(probes: DataFrame) -> DataFrame:
    """One answer per target: the GET answer where HEAD got none or a refusal that
    often only concerns HEAD."""
    side = lambda m: F.max(F.when(F.col("method") == m, F.struct(F.lit(1).alias("asked"), "status")))
    both = probes.groupBy("url").agg(side("HEAD").alias("h"), side("GET").alias("g"))
    retry = F.col("h.status").isNull() | F.col("h.status").isin(405, 501, 403, 400)
    return both.select("url", F.when(retry, F.col("g.status")).otherwise(F.col("h.status")).alias("status"))


def _site(probes: DataFrame, *kinds: str) -> DataFrame:
    """Probe rows (site, kind, path, status, content_type, body, final_url, seq) of
    some kinds, with their verdict. ``kind``: root, robots, sitemap, unknown, http, file."""
    rows = probes.where(F.col("kind").isin(*kinds)).withColumn("page_url", F.concat("site", "path"))
    state = P.verdict(F.col("status"))
    html = P.is_html(F.col("content_type"), F.col("body"))
    return rows.withColumn("state", state).withColumn("html", html)


def blocked_sites(probes: DataFrame) -> DataFrame:
    return _site(probes, "root").where("state = 'blocked'").select("site").distinct()


def site_blocked(probes: DataFrame, agent: str = "the tester") -> DataFrame:
    rows = _site(probes, "root").where("state = 'blocked'")
    title = F.concat(F.lit(f"The site refused {agent} (HTTP "), F.col("status"), F.lit(") - this report is incomplete"))
    return _f(rows, "high", "HTTP Status", title, evidence=G.evidence(status=F.col("status")))


def robots_findings(probes: DataFrame) -> DataFrame:
    rows = _site(probes, "robots")
    state = F.when((F.col("state") == "present") & F.col("html"), "html").otherwise(F.col("state"))
    rows = rows.withColumn("state", state)
    readable = rows.where(F.col("state").isin("html", "missing"))
    out = _f(readable, F.when(F.col("state") == "html", "low").otherwise("info"), "Site Hygiene", "No robots.txt")
    unread = rows.where(F.col("state").isin("blocked", "unreachable")).join(blocked_sites(probes), "site", "left_anti")
    out = out.unionByName(_f(unread, "info", "Site Hygiene", "Could not check robots.txt"))
    shut = rows.where((F.col("state") == "present") & F.col("body").rlike(r"(?im)^\s*disallow:\s*/\s*$"))
    return out.unionByName(_f(shut, "medium", "Site Hygiene", "robots.txt blocks the entire site", evidence=G.evidence(robots_txt=F.col("body"))))


def sitemap_findings(probes: DataFrame) -> DataFrame:
    rows = _site(probes, "sitemap")
    good = (F.col("state") == "present") & ~F.col("html") & F.col("body").rlike(r"(?i)<(urlset|sitemapindex)\b")
    per = rows.groupBy("site").agg(
        F.max(good).alias("found"), F.min_by("status", F.when(F.col("state") == "blocked", F.col("seq"))).alias("refused"), F.min("seq").alias("seq")
    )
    per = per.where("NOT found").join(blocked_sites(probes), "site", "left_anti").withColumn("page_url", F.concat("site", F.lit("/sitemap.xml")))
    none = _f(per.where("refused IS NULL"), "low", "Site Hygiene", "No sitemap.xml found")
    return none.unionByName(_f(per.where("refused IS NOT NULL"), "info", "Site Hygiene", "Could not check sitemap.xml", evidence=G.evidence(status=F.col("refused"))))


def site_probe_findings(probes: DataFrame) -> DataFrame:
    """Soft 404s, plain HTTP, exposed files, security.txt."""
    unknown = _site(probes, "unknown")
    out = _f(unknown.where("status = 200"), "medium", "HTTP Status", "Unknown URLs return HTTP 200 instead of 404")
    out = out.unionByName(_f(unknown.where("status >= 500"), "high", "HTTP Status", F.concat(F.lit("Unknown URLs return HTTP "), F.col("status"))))
    plain = _site(probes, "root").where("site LIKE 'http://%'")
    out = out.unionByName(_f(plain, "critical", "Security", "Site is served over plain HTTP", url=F.col("site")))
    stays = _site(probes, "http").where("site LIKE 'https://%' AND status < 400 AND final_url LIKE 'http://%'")
    out = out.unionByName(_f(stays, "high", "Security", "HTTP is served without redirecting to HTTPS", url=F.concat(F.lit("http://"), F.substr("site", F.lit(9)), F.lit("/"))))
    files = _site(probes, "file")
    sev = label = None
    for path, severity, name in seeds.EXPOSED_PATHS:
        hit = F.col("path") == path
        sev = F.when(hit, severity) if sev is None else sev.when(hit, severity)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    low = F.lower(F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+", ""))
    page = low.startswith("<!doctype") | low.startswith("<html") | low.contains("<body")
    not_json = F.col("path").isin(*seeds.JSON_ONLY_PATHS) & ~low.startswith("{")
    open_ = files.withColumn("label", label).withColumn("sev", sev).where((F.col("status") == 200) & F.col("label").isNotNull() & ~page & ~not_json)
    out = out.unionByName(_f(open_, F.col("sev"), "Exposed File", F.concat("label", F.lit(" is publicly reachable: "), "path"), evidence=G.evidence(excerpt=F.left("body", F.lit(300)))))
    quiet = files.where((F.col("path") == seeds.SECURITY_TXT) & (F.col("state") == "missing")).join(blocked_sites(probes), "site", "left_anti")
    return out.unionByName(_f(quiet, "info", "Site Hygiene", "No security.txt"))


# ------------------------------------------------------------------ N14, N16, N17
def link_findings(links: DataFrame, answers: DataFrame, check_external: bool = True) -> DataFrame:
    """Broken links. ``links``: target, source, text, internal, seq; ``answers``: url,
    status (a missing row or null status is an unreachable target). The eight pages
    shown are cut by a ranked window before the shuffle; the count covers all."""
    rows = links if check_external else links.where("internal")
    pairs = rows.groupBy("target", "source").agg(
        F.min_by("text", F.when(F.col("text") != "", F.col("seq"))).alias("text"), F.min(F.when(F.col("text") != "", F.col("seq"))).alias("text_at"),
        F.max("internal").alias("internal"), F.min("seq").alias("seq"),
    )
    per = pairs.groupBy("target").agg(
        F.count("*").alias("n"), F.min_by("text", "text_at").alias("text"), F.max("internal").alias("internal"), F.min("seq").alias("seq")
    )
    bad = per.join(answers.select(F.col("url").alias("target"), "status"), "target", "left").where("status IS NULL OR status >= 400")
    w = Window.partitionBy("target").orderBy("source")
    shown = (
        pairs.select("target", "source", F.row_number().over(w).alias("place"))
        .where("place <= 8")
        .groupBy("target")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("sources"))
    )
    bad = bad.join(shown, "target")
    gone = F.col("status").isNull()
    refused = F.col("status").isin(401, 403)
    sev = F.when(~gone & refused, F.when(F.col("internal"), "medium").otherwise("low")).otherwise(F.when(F.col("internal"), "high").otherwise("medium"))
    title = F.when(gone, F.concat(F.lit("Link unreachable: "), U.shorten(F.col("target"), 70))).otherwise(
        F.concat(F.lit("HTTP "), F.col("status"), F.lit(" link: "), U.shorten(F.col("target"), 65))
    )
    return _f(
        bad, sev, "Broken Link", title, url=F.get("sources", 0), other_urls=F.slice("sources", 2, 7), occurrences=F.col("n"),
        evidence=G.evidence(target=F.col("target"), status=F.col("status"), link_text=F.coalesce("text", F.lit(""))),
    )


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Titles that several addresses share (page_url, title, status, seq)."""
    rows = pages.where("title <> '' AND status < 400").withColumn("title", F.trim("title"))
    urls = rows.groupBy("title", "page_url").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("title").orderBy("seq", "page_url")
    shown = (
        urls.withColumn("place", F.row_number().over(w)).where("place <= 12").groupBy("title")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page_url"))), lambda x: x["page_url"]).alias("urls"))
    )
    per = urls.groupBy("title").agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n > 1").join(shown, "title")
    title = F.concat(F.col("n"), F.lit(' pages share the same <title>: "'), F.left("title", F.lit(60)), F.lit('"'))
    return _f(
        per, "low", "SEO", title, url=F.get("urls", 0), other_urls=F.slice("urls", 2, 7), occurrences=F.col("n"),
        evidence=G.evidence(pages=F.to_json("urls")),
    )


def a11y_findings(violations: DataFrame) -> DataFrame:
    """Accessibility checker results (page_url, seq, rule, impact, help, total)."""
    rows = violations.where(~F.col("rule").isin(*seeds.A11Y_SKIPPED_RULES))
    sev = None
    for impact, severity in seeds.IMPACT_SEVERITY:
        hit = F.coalesce("impact", F.lit("minor")) == impact
        sev = F.when(hit, severity) if sev is None else sev.when(hit, severity)
    return _f(rows, sev.otherwise("info"), "Accessibility", F.col("help"), occurrences=F.coalesce("total", F.lit(1)), evidence=G.evidence(rule=F.col("rule"), impact=F.col("impact")))


# ------------------------------------------------------------------ N18 - N22: forms and controls
def form_findings(forms: DataFrame, logged_in: bool = False, per_page: int | None = None) -> DataFrame:
    """Judge forms without sending them (page_url, seq, signature, fields, has_submit,
    submit_text, novalidate, has_password, action, id, name, selector). Every distinct
    form once; with ``per_page`` only the first usable ones of each page."""
    shown = F.filter("fields", lambda x: ~x["type"].isin("hidden", "submit", "button", "reset"))
    rows = forms.withColumn("shown", shown).where(F.size("shown") > 0)
    cols = [c for c in rows.columns if c != "signature"]
    once = rows.groupBy("signature").agg(F.min_by(F.struct(*cols), "seq").alias("f")).select("signature", "f.*")
    blob = F.concat_ws(" ", F.coalesce("submit_text", F.lit("")), F.coalesce("action", F.lit("")), F.coalesce("id", F.lit("")))
    once = once.withColumn("danger", X.has_danger_word(blob))
    label = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("submit_text", "action", "selector")], F.lit(""))
    left = _f(once.where("danger"), "info", "Skipped", F.concat(F.lit("Form not submitted (looks destructive/transactional): "), label), element=F.col("selector"))
    w = Window.partitionBy("page_url").orderBy("seq")
    used = once.where("NOT danger")
    if per_page is not None:
        used = used.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_page)
    names = F.array_join(F.transform("shown", lambda x: x["name"]), " ")
    searches = P.is_search_form(F.col("action"), F.col("id"), F.col("name"), names) | F.exists("shown", lambda x: x["type"] == "search")
    none_required = ~F.exists("shown", lambda x: x["required"]) & (F.size("shown") > 1) & ~searches
    row = lambda when, sev, cat, title: F.when(when, F.struct(F.lit(sev).alias("severity"), F.lit(cat).alias("category"), F.lit(title).alias("title")))
    checks = F.array(
        row(~F.col("has_submit"), "low", "Forms", "Form has no submit button"),
        row(F.col("novalidate"), "info", "Forms", "Form has novalidate - browser validation is switched off"),
        row(none_required, "medium", "Forms", "Form has no required fields at all"),
        row(F.lit(logged_in) & F.col("has_password"), "info", "Skipped", "Form with a password field not submitted (a test login is in use)"),
    )
    found = used.select("page_url", "seq", "selector", F.posexplode(F.filter(checks, lambda x: x.isNotNull())).alias("pos", "x"))
    return left.unionByName(_f(found, F.col("x.severity"), F.col("x.category"), F.col("x.title"), element=F.col("selector")))


def action_delta(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Events between an action and the next one of the same page. Both sides are
    rows of one stream per page; a running maximum gives every event its action.

    Pages with very many events are first cut into time slots: the last action of
    each slot is carried forward over slot totals, so no page is one task's work.
    """
    slot = F.floor(F.col("at") / F.lit(SLOT))
    rows = actions.select("page_url", F.col("at"), F.lit(0).alias("kind_rank"), F.col("action_id"), F.lit(None).cast("string").alias("event"))
    if "payload" in events.columns:
        rows = rows.withColumn("payload", F.lit(None).cast(events.schema["payload"].dataType))
        ev = events.select("page_url", "at", F.lit(1).alias("kind_rank"), F.lit(None).cast("bigint").alias("action_id"), "event", "payload")
    else:
        ev = events.select("page_url", "at", F.lit(1).alias("kind_rank"), F.lit(None).cast("bigint").alias("action_id"), "event")
    rows = rows.withColumn("action_id", F.col("action_id").cast("bigint")).unionByName(ev).withColumn("slot", slot)
    last = rows.where("action_id IS NOT NULL").groupBy("page_url", "slot").agg(F.max_by("action_id", F.struct("at", "action_id")).alias("last_action"))
    slots = rows.select("page_url", "slot").distinct().join(last, ["page_url", "slot"], "left")
    earlier = Window.partitionBy("page_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("page_url", "slot", F.last("last_action", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("page_url", "slot").orderBy("at", "kind_rank", "action_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("near", F.last("action_id", ignorenulls=True).over(inside))
    joined = near.where("event IS NOT NULL").join(carried, ["page_url", "slot"])
    keep = [c for c in ("page_url", "at", "event", "payload") if c in near.columns]
    return joined.select(F.coalesce("near", "carried").alias("action_id"), *keep).where("action_id IS NOT NULL")


#: width of a time slot, in units of ``at``
SLOT = 3_600_000


def action_findings(actions: DataFrame, delta: DataFrame, logged_in: bool = False) -> DataFrame:
    """What a recorded click led to. ``actions``: action_id, page_url, seq, text, tag,
    selector and before/after struct (url, html, text, dialogs, scroll, hash, copies,
    popups, downloads), restless; ``delta``: action_id, event (error | response |
    dialog), payload struct (message, url, status, resource_type, seq)."""
    name = lambda n: F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.left(F.trim("text"), F.lit(n))).otherwise(F.col("tag"))
    ev = delta.select("action_id", "event", "payload.*").join(actions.drop("seq"), "action_id")
    refused = P.clipboard_refusal(F.col("message"))
    err = ev.where("event = 'error'")
    out = _f(err.where(refused), "info", "Interaction", "A copy button could not be checked (the test browser has no clipboard)", element=F.col("selector"))
    out = out.unionByName(_f(err.where(~refused), "critical", "JavaScript Error", F.concat(F.lit("Clicking '"), name(45), F.lit("' throws: "), F.left("message", F.lit(80))), element=F.col("selector")))
    resp = ev.where("event = 'response'")
    out = out.unionByName(_f(resp.where("status >= 500"), "critical", "Server Error", F.concat(F.lit("Clicking '"), name(40), F.lit("' returns HTTP "), F.col("status")), element=F.col("selector")))
    api = resp.where("status IN (401, 403, 404) AND resource_type IN ('xhr', 'fetch')")
    if not logged_in:
        api = api.where(~P.is_auth_probe(F.col("resource_type"), F.col("status"), F.col("url")))
    out = out.unionByName(_f(api, "high", "Network", F.concat(F.lit("Clicking '"), name(40), F.lit("' calls a "), F.col("status"), F.lit(" endpoint")), element=F.col("selector")))
    dlg = ev.where("event = 'dialog'")
    out = out.unionByName(_f(dlg, "low", "UX", F.concat(F.lit("Native browser dialog ("), F.col("resource_type"), F.lit(") opened by '"), name(40), F.lit("'")), element=F.col("selector")))
    busy = delta.where(F.col("event").isin("error", "dialog") | ((F.col("event") == "response") & F.col("payload.resource_type").isin("xhr", "fetch", "document")))
    d = lambda f: F.abs(F.col(f"after.{f}") - F.col(f"before.{f}"))
    changed = (
        (F.col("after.url") != F.col("before.url")) | (d("html") > 12) | (d("text") > 6) | (d("dialogs") != 0) | (d("scroll") > 30)
        | (~F.col("restless") & (F.col("after.hash") != F.col("before.hash")))
        | (F.col("after.copies") > F.col("before.copies")) | (F.col("after.popups") > F.col("before.popups")) | (F.col("after.downloads") > F.col("before.downloads"))
    )
    dead = actions.where(~changed).join(busy.select("action_id").distinct(), "action_id", "left_anti")
    return out.unionByName(_f(dead, "low", "Dead Control", F.concat(F.lit("Control appears to do nothing: '"), name(50), F.lit("'")), element=F.col("selector")))


def submission_findings(submissions: DataFrame, responses: DataFrame) -> DataFrame:
    """Grade recorded form submissions. ``submissions``: submission_id, page_url, seq,
    selector, mode (empty | bad_email | valid), navigated, bypassed, valid_before,
    body_text, has_password, still_password, dialogs, js_error, echoed;
    ``responses``: submission_id, status, resource_type, method, seq."""
    relevant = F.col("resource_type").isin("xhr", "fetch", "document")
    posts = relevant & F.col("method").isin("POST", "PUT", "PATCH", "GET")
    client = relevant & F.col("status").between(400, 499)
    per = responses.groupBy("submission_id").agg(
        F.count_if(posts).alias("posts"), F.count_if(client).alias("client"), F.count_if(F.col("status") >= 500).alias("server")
    )
    s = submissions.join(per, "submission_id", "left").fillna(0, ["posts", "client", "server"])
    s = s.withColumn("shows_error", F.coalesce("body_text", F.lit("")).rlike(seeds.ERROR_TEXT))
    s = s.withColumn("success", F.coalesce("body_text", F.lit("")).rlike(seeds.SUCCESS_TEXT))
    s = s.withColumn("accepted", F.expr("navigated OR (posts > 0 AND NOT shows_error AND client = 0)"))
    label = F.when(F.col("mode") == "empty", "empty submission").when(F.col("mode") == "bad_email", "invalid e-mail").otherwise("valid test data")
    s = s.withColumn("label", label)
    row = lambda when, sev, cat, title: F.when(F.expr(when) if isinstance(when, str) else when, F.struct(
        F.lit(sev).alias("severity"), F.lit(cat).alias("category"), (title if isinstance(title, Column) else F.lit(title)).alias("title")))
    blocked = "bypassed OR (valid_before = false AND NOT navigated AND posts = 0)"
    empty = F.when(F.expr("bypassed AND accepted"), row("true", "high", "Forms", "Server accepts an empty submission (validation is browser-side only)")).when(
        F.expr(f"NOT coalesce({blocked}, false) AND accepted"), row("true", "high", "Forms", "Form accepts a completely empty submission")).when(
        F.expr("NOT bypassed AND NOT accepted AND NOT shows_error AND NOT navigated AND posts = 0 AND coalesce(valid_before, true)"),
        row("true", "medium", "Forms", "Empty submission is silently ignored"))
    login = row("NOT shows_error AND NOT still_password AND navigated", "critical", "Authentication", "Credentials form accepted made-up login details")
    silent = row("NOT shows_error AND NOT navigated AND posts = 0", "medium", "Forms", "Login form gives no feedback for wrong credentials")
    idle = row("NOT navigated AND posts = 0 AND dialogs = 0 AND NOT shows_error AND NOT success", "high", "Forms", "Form does nothing when submitted with valid data")
    picky = row("shows_error AND client = 0 AND server = 0", "medium", "Forms", "Valid test data produces an error message")
    valid = F.col("mode") == "valid"
    checks = F.array(
        row(F.col("js_error").isNotNull(), "critical", "JavaScript Error", F.concat(F.lit("Submitting the form ("), F.col("label"), F.lit(") throws: "), F.left("js_error", F.lit(80)))),
        F.when(F.col("mode") == "empty", empty),
        F.when(F.col("mode") == "bad_email", row("accepted", "medium", "Forms", "Form accepts an invalid e-mail address")),
        F.when(valid & F.col("has_password"), F.coalesce(login, silent)),
        F.when(valid & ~F.col("has_password"), F.coalesce(idle, picky)),
        F.when(valid, row("echoed", "high", "Security", "User input is rendered as raw HTML (output not escaped)")),
    )
    found = s.select("page_url", "seq", "selector", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("x"))
    out = _f(found, F.col("x.severity"), F.col("x.category"), F.col("x.title"), element=F.col("selector"))
    each = responses.select("submission_id", "status", "resource_type").join(s.drop("status"), "submission_id")
    down = each.where("status >= 500")
    out = out.unionByName(_f(down, "critical", "Server Error", F.concat(F.lit("Form submission returns HTTP "), F.col("status"), F.lit(" ("), F.col("label"), F.lit(")")), element=F.col("selector")))
    bad = each.where(client & valid & ~F.col("has_password"))
    return out.unionByName(_f(bad, "medium", "Forms", F.concat(F.lit("Form submission returns HTTP "), F.col("status")), element=F.col("selector")))


def skipped_controls(clickables: DataFrame) -> DataFrame:
    """Controls a tester leaves alone because they look destructive; each distinct
    control once, disabled ones and submit buttons of forms not at all."""
    text = F.trim(F.coalesce("text", F.lit("")))
    sig = F.concat_ws("|", "tag", "selector", F.left(text, F.lit(40)))
    cols = ["page_url", "seq", "tag", "selector", "text", "html", "disabled", "in_form", "type"]
    once = clickables.withColumn("text", text).groupBy(sig.alias("signature")).agg(F.min_by(F.struct(*cols), "seq").alias("c")).select("c.*")
    usable = once.where("NOT disabled AND NOT (in_form AND type IN ('submit', '') AND tag IN ('button', 'input'))")
    risky = usable.where(X.is_dangerous(F.col("text"), F.col("html")))
    shown = F.when(F.col("text") != "", F.left("text", F.lit(50))).otherwise(F.col("tag"))
    return _f(risky, "info", "Skipped", F.concat(F.lit("Destructive-looking control not clicked: '"), shown, F.lit("'")), element=F.col("selector"))
