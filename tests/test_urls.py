"""URL expressions against Python's own URL library on awkward addresses."""

from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import urls as U


def expected(url, base):
    if not url:
        return None
    u = url.strip()
    if any(u.lower().startswith(s) for s in seeds.NON_PAGE_SCHEMES):
        return None
    p = urlparse(urldefrag(urljoin(base, u) if base else u)[0])
    if p.scheme not in ("http", "https") or not p.netloc:
        return None
    host = p.netloc.lower()
    if p.scheme == "http":
        host = host.removesuffix(":80")
    else:
        host = host.removesuffix(":443")
    qs = [kv for kv in parse_qsl(p.query, keep_blank_values=True) if kv[0].lower() not in seeds.TRACKING_PARAMS]
    path = p.path or "/"
    if len(path) > 1:
        path = path.rstrip("/") or "/"
    return urlunparse((p.scheme, host, path, "", urlencode(qs), ""))


BASES = [None, "https://www.Example.co.uk:443/a/b/c?x=1#f", "http://h.test", "http://h.test/d/", "https://h.test/a;v=1/b;p"]
HREFS = [
    "", "  ", "/x", "x", "./x", "../x", "../../../x", "..", ".", "a/../b/", "/a/./b/../c", "//other.test/p",
    "?q=1", "?q=1&utm_source=z&UTM_Medium=y&a", "#frag", "HTTP://H.Test:80/A//B/", "https://h.test:443",
    "https://h.test:80/p", "mailto:a@b.c", "JavaScript:void(0)", "tel:1", "ftp://x/y", "data:,x", "http:rel/p",
    "https:rel", "http:///nohost", "/p;v=1", "/p;v=1/q;w=2", ";x", "/s p?a=b c&d=%7E*~&e=%zz&f=%C3%A9&g=+1",
    "?a=1&&b=&=c&gclid=9", "/tr///", "////x//y", "/a\nb", " /lead\t", "http://u:p@H.test/x", "a//b", "x/./", "/../x",
    "/é/ü?ö=ä", "http://h.test?x=1", "http://h.test#y", "page.html?next=/a/b?c=d#e", "foo:bar", "1:2",
]


@pytest.mark.parametrize("base", BASES)
def test_normalise_equals_standard_library(spark, base):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HREFS)], "i int, h string")
    b = None if base is None else F.lit(base)
    got = {r.i: r.n for r in df.select("i", U.normalise("h", b).alias("n")).collect()}
    want = {i: expected(h, base) for i, h in enumerate(HREFS)}
    assert {HREFS[i]: v for i, v in got.items()} == {HREFS[i]: v for i, v in want.items()}


def test_hosts(spark):
    rows = [
        ("www.shop.example.co.uk:8080", "example.co.uk", "shop.example.co.uk:8080"),
        ("127.0.0.1", "0.1", "127.0.0.1"),
        ("localhost:1", "localhost", "localhost:1"),
        ("a.b.example.com", "example.com", "a.b.example.com"),
        ("x.com.museum", "com.museum", "x.com.museum"),
        ("WWW.www.a.io", "a.io", "www.a.io"),
    ]
    df = spark.createDataFrame(rows, "h string, reg string, key string")
    bad = df.where((U.registrable("h") != F.col("reg")) | (U.host_key("h") != F.col("key"))).collect()
    assert bad == []


def test_gate_shorten_slug(spark):
    base = F.lit("https://h.test/")
    rows = [
        ("https://h.test/a", None), ("https://www.h.test/a", None), ("https://o.test/a.png", "external"),
        ("https://h.test/a.PNG", "asset"), ("https://h.test/a.pdf", "document"), ("https://h.test/logout", "unsafe/destructive URL"),
        ("https://h.test/x?a=1&action=delete", "unsafe/destructive URL"), ("https://h.test/priv", "excluded by --exclude"),
    ]
    df = spark.createDataFrame(rows, "u string, want string")
    bad = df.where(~U.visit_gate("u", base, exclude=["/priv"]).eqNullSafe(F.col("want"))).collect()
    assert bad == []
    long = "x" * 100 + "end"
    r = spark.createDataFrame([(long,)], "u string").select(
        U.shorten("u", 70).alias("s"), U.slug(F.lit("--Hello, World--")).alias("g"), U.slug(F.lit("")).alias("e")
    ).first()
    assert r.s == long[:55] + "…" + long[-14:] and (r.g, r.e) == ("hello-world", "shot")
