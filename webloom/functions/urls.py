"""URL and host expressions (Column in, Column out; all inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom import seeds

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_DOTS = r"(^|/)\.\.?(/|$)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def _clean(url: Column) -> Column:
    """Outer white space off; tabs and line ends inside a URL vanish."""
    trimmed = F.regexp_replace(url, r"(?U)^[\s\x00-\x20]+|[\s\x00-\x20]+$", "")
    return F.translate(trimmed, "\t\r\n", "")


def _parts(url: Column) -> Column:
    """[scheme, host, path, query] with one pass of one regex."""
    return F.split(F.regexp_replace(url, _SPLIT, "$1\n$2\n$3\n$4"), "\n", 5)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def scheme_of(url) -> Column:
    return F.lower(_part(_c(url), 1))


def netloc_of(url) -> Column:
    return _part(_c(url), 2)


def query_of(url) -> Column:
    return _part(_c(url), 4)


def _no_params(path: Column) -> Column:
    return F.regexp_replace(path, r";[^/]*$", "")


def raw_path(url) -> Column:
    return _no_params(_part(_c(url), 3))


def path_of(url) -> Column:
    """Path of a URL, ``/`` when it has none."""
    p = raw_path(url)
    return F.when(p == "", "/").otherwise(p)


def origin(url) -> Column:
    return F.concat(scheme_of(url), F.lit("://"), netloc_of(url))


def host_key(netloc) -> Column:
    """Host for scope comparison: lower case, one leading ``www.`` off, port kept."""
    return F.regexp_replace(F.lower(_c(netloc)), r"^www\.", "")


def registrable(host) -> Column:
    """Rough registrable domain: two labels, three under a known second level."""
    bare = F.substring_index(F.lower(_c(host)), ":", 1)
    two = F.substring_index(bare, ".", -2)
    known = F.substring_index(two, ".", 1).isin(*seeds.SECOND_LEVEL_LABELS) & (F.length(F.substring_index(two, ".", -1)) <= 3)
    return F.when(known, F.substring_index(bare, ".", -3)).otherwise(two)


def authority_part(url) -> Column:
    """Whatever stands between the last ``//`` and the next ``/``; slashes pair up from the left."""
    url = _c(url)
    after = F.when(F.contains(url, F.lit("///")), F.element_at(F.split(url, "//"), -1)).otherwise(F.substring_index(url, "//", -1))
    return F.substring_index(after, "/", 1)


def domain_of(url) -> Column:
    return registrable(authority_part(url))


def same_scope(url, base, allow_subdomains: bool = False) -> Column:
    a, b = netloc_of(url), netloc_of(base)
    key = registrable if allow_subdomains else host_key
    return key(a) == key(b)


def _fold_dots(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments away, as a browser resolves them."""
    segs = F.split(path, "/")
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(folded, closing), "/")


def _merge(b_path: Column, u_path: Column) -> Column:
    """Path of a reference that has no host of its own."""
    folder = F.regexp_replace(_no_params(b_path), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    near = F.regexp_replace(F.concat(folder, u_path), r"/{2,}", "/")
    joined = F.when(u_path.startswith("/"), u_path).otherwise(near)
    return let(joined, lambda p: F.when(p.rlike(_DOTS), _fold_dots(p)).otherwise(p))


def _located(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    return F.struct(
        F.lower(scheme).alias("scheme"), netloc.alias("netloc"), path.alias("path"), query.alias("query")
    )


def _resolved(u: Column, b: Column | None) -> Column:
    """Where reference ``u`` leads, seen from base ``b`` (both split in parts)."""
    u_scheme, u_net, u_path, u_query = (F.get(u, i) for i in range(4))
    own = _located(u_scheme, u_net, _no_params(u_path), u_query)
    if b is None:
        return own
    b_scheme, b_net, b_path, b_query = (F.get(b, i) for i in range(4))
    foreign = (u_scheme != "") & (F.lower(u_scheme) != F.lower(b_scheme))
    scheme = F.when(u_scheme == "", b_scheme).otherwise(u_scheme)
    stays = u_path == ""
    path = F.when(stays, _no_params(b_path)).otherwise(_merge(b_path, _no_params(u_path)))
    query = F.when(stays & (u_query == ""), b_query).otherwise(u_query)
    return (
        F.when(foreign, own)
        .when(u_net != "", _located(scheme, u_net, _no_params(u_path), u_query))
        .otherwise(_located(scheme, b_net, path, query))
    )


def _target(url: Column, base: Column | None, body) -> Column:
    """``body(location)`` for the place ``url`` leads to."""
    if base is None:
        return let(_parts(url), lambda u: let(_resolved(u, None), body))
    return let(
        _parts(url), lambda u: let(_parts(_clean(base)), lambda b: let(_resolved(u, b), body))
    )


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def resolve(base, href) -> Column:
    """Absolute form of ``href`` seen from ``base``, without its fragment and path parameters."""
    ref = _c(href)

    def whole(at: Column) -> Column:
        path = F.when(at["path"] == "", "").otherwise(_rooted(at["path"]))
        tail = F.when(at["query"] != "", F.concat(F.lit("?"), at["query"])).otherwise("")
        return F.when(
            at["netloc"] != "", F.concat(at["scheme"], F.lit("://"), at["netloc"], path, tail)
        ).otherwise(ref)

    return _target(_clean(ref), _c(base), whole)


def _form_decode(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_query(query: Column) -> Column:
    """Query without tracking parameters, blank values kept, re-encoded."""
    pair = lambda p: F.struct(
        _form_decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
        _form_decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
    )
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    kept = F.filter(pairs, lambda kv: ~F.lower(kv["k"]).isin(*seeds.TRACKING_PARAMS))
    written = F.transform(kept, lambda kv: F.concat(_form_encode(kv["k"]), F.lit("="), _form_encode(kv["v"])))
    return F.when(query == "", "").otherwise(F.array_join(written, "&"))


def _canonical(at: Column) -> Column:
    path = F.regexp_replace(_rooted(at["path"]), r"(?<=.)/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    port = F.when(at["scheme"] == "http", ":80").otherwise(":443")
    net = F.lower(at["netloc"])
    net = F.when(net.endswith(port), F.left(net, F.length(net) - F.length(port))).otherwise(net)
    query = let(clean_query(at["query"]), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(
        at["scheme"].isin("http", "https") & (at["netloc"] != ""),
        F.concat(at["scheme"], F.lit("://"), net, path, query),
    )


def normalise(url, base=None) -> Column:
    """Absolute, fragment-free, tracking-free URL; null when it is not a page address."""
    raw = _c(url)
    not_page = "(?i)^(" + "|".join(seeds.NON_PAGE_SCHEMES) + ")"
    b = None if base is None else _c(base)
    found = let(_clean(raw), lambda h: F.when(~h.rlike(not_page), _target(h, b, _canonical)))
    return F.when(raw != "", found)


def is_asset(url) -> Column:
    return raw_path(url).rlike(seeds.ASSET_PATH)


def is_document(url) -> Column:
    return raw_path(url).rlike(seeds.DOCUMENT_PATH)


def shorten(url, limit: int = 70) -> Column:
    u = _c(url)
    cut = F.concat(F.substring(u, 1, limit - 15), F.lit("…"), F.right(u, F.lit(14)))
    return F.when(F.length(u) <= limit, u).otherwise(cut)


def is_utility(domain) -> Column:
    return host_key(F.coalesce(_c(domain), F.lit(""))).isin(*seeds.UTILITY_DOMAINS)


def is_infrastructure(domain) -> Column:
    return host_key(F.coalesce(_c(domain), F.lit(""))).isin(*seeds.INFRASTRUCTURE_DOMAINS)


def slug(text) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    t = F.when(t == "", "shot").otherwise(t)
    s = F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, 40)
    return F.when(s == "", "shot").otherwise(s)


def any_match(text: Column, patterns) -> Column:
    """True when any of the regexes is found (one alternation, one pass)."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def visit_gate(url, base, allow_subdomains: bool = False, exclude=(), include=(), documents: bool = False) -> Column:
    """Why a crawl would leave this URL alone, or null. The cheapest test first."""
    u = _c(url)
    asset, doc = is_asset(u), is_document(u)
    gate = F.when(~same_scope(u, base, allow_subdomains), "external").when(asset & ~doc, "asset")
    if not documents:
        gate = gate.when(doc, "document")
    gate = gate.when(any_match(u, seeds.UNSAFE_URL_PATTERNS), "unsafe/destructive URL")
    if exclude:
        gate = gate.when(any_match(u, exclude), "excluded by --exclude")
    if include:
        gate = gate.when(~any_match(u, include), "not matched by --include")
    return gate
