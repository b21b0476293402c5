"""Page rules: static HTML facts and the findings they lead to.

Facts and rules stay in the page's row, so the audit of any number of pages is one
scan without a shuffle. Visibility and layout need a browser and are not judged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom import seeds
from webloom.functions import html as H
from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.functions.urls import let
from webloom.operators import findings as G

ANY = r"[a-z][^\s/>]*"
_CONTROL = rf"<(?:input|select|textarea)(?=[\s/>]){H.ATTRS}>"
_LABEL = rf"<label(?=[\s/>]){H.ATTRS}>.*?(?:</label\s*>|(?=<label(?=[\s/>]))|\z)"
_FIELD_ITEMS = rf"(?is){_LABEL}|{_CONTROL}"
_ROLE_BUTTON = rf"""(?is)<((?!button|input)[a-z][a-z0-9]*)(?=[\s/>])(?=[^>]*\srole\s*=\s*["']?button\b){H.ATTRS}>.*?</\1\s*>"""
_ARIA_HIDDEN = rf"""(?is)<([a-z][a-z0-9]*)(?=[\s/>])(?=[^>]*\saria-hidden\s*=\s*["']?true\b){H.ATTRS}>.*?</\1\s*>"""
_NATIVE_BLOCK = rf"(?is)<(a|button)(?=[\s/>]){H.ATTRS}>.*?</\1\s*>"
_NATIVE = "a button input select textarea summary label details option iframe video audio".split()
_ONCLICK = rf"(?is)<([a-z][a-z0-9]*)(?=[\s/>])(?=[^>]*\sonclick[\s=/>]){H.ATTRS}>.*?</\1\s*>"
_ROLE_OK = (
    r"^(button|link|tab|menuitem|menuitemcheckbox|menuitemradio|option|checkbox|radio|switch|treeitem|gridcell|row)$"
)
_EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
_NOT_FIELDS = ["hidden", "submit", "button", "reset", "image"]
_UI = "a|button|label|summary|legend|h[1-6]|th"


def _of(m: Column, names: str, make: Callable[[Column, Column], Column]) -> Column:
    """make(tag, attributes) for every open tag of the page with one of the names."""
    return F.transform(H.tags(m, names), lambda t: let(H.attrs(t), lambda a: make(t, a)))


def _blocks(m: Column, names: str, make: Callable[[Column, Column], Column]) -> Column:
    return F.transform(H.blocks(m, names), lambda t: let(H.attrs(t), lambda a: make(t, a)))


def _part(*marks: str) -> Column:
    """The page's markup ``m``, or '' when it holds none of the marks (lower case, looked up in ``low``), so that
    a regex that needs one of them does not walk through pages without it."""
    any_mark = reduce(Column.__or__, (F.contains(F.col("low"), F.lit(x)) for x in marks))
    return F.when(~any_mark, "").otherwise(F.col("m"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _field(tag: Column, label: Column, near: Column, after_orphan: Column) -> Column:
    def make(a: Column) -> Column:
        name = H.tag_name(tag)
        kind = F.when(name == "textarea", "textarea").when(name == "select", "select-one").otherwise(
            F.coalesce(F.lower(H.attr(a, "type")), F.lit("text"))
        )
        return F.struct(
            kind.alias("type"),
            _text(H.attr(a, "name")).alias("name"),
            _text(H.attr(a, "id")).alias("id"),
            _text(H.attr(a, "placeholder")).alias("placeholder"),
            (H.has_attr(a, "required") | (_text(H.attr(a, "aria-required")) == "true")).alias("required"),
            H.has_attr(a, "autocomplete").alias("autocomplete"),
            _text(H.attr(a, "aria-label")).alias("aria"),
            _text(H.attr(a, "aria-labelledby")).alias("labelledby"),
            label.alias("wrap"),
            near.alias("near"),
            after_orphan.alias("after_orphan"),
            H.selector(name, a).alias("selector"),
        )

    return let(H.attrs(tag), make)


def _fields(items: Column, ids: Column) -> Column:
    """Form fields in order, with the label around or right before each."""
    is_label = lambda it: it.rlike(r"(?i)^<label[\s/>]")
    holds = lambda it: it.rlike("(?is)" + _CONTROL)
    none = F.lit(None).cast("string")

    def lone_label(it: Column) -> Column:
        return F.coalesce(is_label(it) & ~holds(it), F.lit(False))

    def orphan(it: Column) -> Column:
        target = H.attr(H.attrs(it), "for")
        return lone_label(it) & F.coalesce((target != "") & ~F.array_contains(ids, target), F.lit(False))

    def at(it: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(items, i - 1))
        inside = F.transform(
            F.regexp_extract_all(it, F.lit("(?is)" + _CONTROL), 0),
            lambda c: _field(c, H.text_of(H.inner(it)), none, F.lit(False)),
        )
        bare = F.array(_field(it, none, F.when(lone_label(before), H.text_of(H.inner(before))), orphan(before)))
        return F.when(is_label(it), inside).otherwise(bare)

    return F.filter(F.flatten(F.transform(items, at)), lambda f: ~f["type"].isin(*_NOT_FIELDS))


def page_facts(pages: DataFrame) -> DataFrame:
    """One row of facts per page. Needs page_id, url, html; uses is_entry, lang and
    rendered_chars when present."""
    have = set(pages.columns)
    opt = lambda c, kind, default: (F.col(c) if c in have else F.lit(default)).cast(kind).alias(c)
    p = pages.select(
        "page_id", "url", opt("is_entry", "boolean", False), opt("rendered_chars", "int", None),
        H.markup(F.col("html")).alias("m"), H.visible_text(F.col("html")).alias("text"),
    )
    p = p.withColumn("low", F.lower("m"))
    m = F.col("m")
    meta = _of(
        _part("<meta"), "meta",
        lambda t, a: F.struct(
            F.lower(_text(H.attr(a, "name"))).alias("name"), F.lower(_text(H.attr(a, "property"))).alias("property"),
            F.trim(_text(H.attr(a, "content"))).alias("content"), H.attr(a, "charset").alias("charset"),
        ),
    )
    link = _of(_part("<link"), "link", lambda t, a: F.struct(F.lower(_text(H.attr(a, "rel"))).alias("rel"), H.attr(a, "href").alias("href")))
    anchors = _blocks(
        _part("<a"), "a",
        lambda t, a: F.struct(
            H.attr(a, "href").alias("href"), H.text_of(H.inner(t)).alias("text"), _text(H.attr(a, "target")).alias("target"),
            F.lower(_text(H.attr(a, "rel"))).alias("rel"), H.selector(F.lit("a"), a).alias("selector"),
        ),
    )
    labels = _blocks(_part("<label"), "label", lambda t, a: F.struct(H.attr(a, "for").alias("to"), H.text_of(H.inner(t)).alias("text")))
    all_tags = _of(
        m, ANY,
        lambda t, a: F.struct(
            F.coalesce(H.attr(a, "src"), H.attr(a, "href")).alias("ref"), H.attr(a, "id").alias("id"),
            H.has_attr(a, "style").alias("style"), H.attr(a, "placeholder").alias("placeholder"),
        ),
    )
    p = p.withColumn("meta", meta).withColumn("links", link).withColumn("anchors", anchors)
    p = p.withColumn("tags", all_tags).withColumn("labels", labels)
    p = p.withColumn("ids", F.filter(F.transform("tags", lambda t: t["id"]), lambda i: i.isNotNull() & (i != "")))
    p = p.withColumn("fields", _fields(F.regexp_extract_all(_part("<label", "<input", "<select", "<textarea"), F.lit(_FIELD_ITEMS), 0), F.col("ids")))
    named = lambda n: F.get(F.filter("meta", lambda x: x["name"] == n), 0)["content"]
    imgs = _of(_part("<img"), "img", lambda t, a: F.struct(
        H.attr(a, "src").alias("src"), H.has_attr(a, "alt").alias("alt"), H.selector(F.lit("img"), a).alias("selector"),
        (~H.has_attr(a, "width") | ~H.has_attr(a, "height")).alias("no_size")))
    nameless_link = F.filter(
        F.transform(
            H.blocks(F.when(~F.contains("low", F.lit("aria-hidden")), _part("<a")).otherwise(F.regexp_replace(m, _ARIA_HIDDEN, " ")), "a"),
            lambda t: F.struct(H.attr(H.attrs(t), "href").alias("href"), H.accessible_name(t).alias("name")),
        ),
        lambda x: x["href"].isNotNull() & (x["name"] == ""),
    )
    buttons = F.concat(
        H.blocks(_part("<button"), "button"),
        F.regexp_extract_all(_part("role"), F.lit(_ROLE_BUTTON), 0),
        F.filter(H.tags(_part("<input"), "input"), lambda t: F.lower(_text(H.attr(H.attrs(t), "type"))).isin("submit", "button")),
    )
    nameless_button = F.filter(buttons, lambda t: H.accessible_name(t) == "")
    forms = _blocks(_part("<form"), "form", lambda t, a: F.struct(
        H.attr(a, "action").alias("action"), F.lower(F.coalesce(H.attr(a, "method"), F.lit("get"))).alias("method"),
        _text(H.attr(a, "id")).alias("id"), _text(H.attr(a, "name")).alias("name"), H.has_attr(a, "novalidate").alias("novalidate"),
        H.selector(F.lit("form"), a).alias("selector"),
        F.transform(
            H.tags(t, "input|select|textarea"),
            lambda c: let(H.attrs(c), lambda b: F.struct(
                _text(H.attr(b, "name")).alias("name"), F.lower(F.coalesce(H.attr(b, "type"), H.tag_name(c))).alias("type"),
                H.has_attr(b, "required").alias("required"))),
        ).alias("fields"),
        F.get(F.filter(
            F.concat(H.blocks(t, "button"), H.tags(t, "input")),
            lambda c: let(F.lower(_text(H.attr(H.attrs(c), "type"))), lambda k: (k == "submit") | ((k == "") & (H.tag_name(c) == "button"))),
        ), 0).alias("submit"),
    ))
    sorted_ids = F.array_sort("ids")
    twice = let(sorted_ids, lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))
    levels = F.transform(F.regexp_extract_all(_part("<h"), F.lit(rf"(?is)<h([1-6])(?=[\s/>]){H.ATTRS}>"), 1), lambda x: x.cast("int"))
    skips = let(levels, lambda s: F.filter(
        F.transform(s, lambda x, i: F.struct(F.when(i > 0, F.get(s, i - 1)).alias("from"), x.alias("to"))),
        lambda z: z["to"] > z["from"] + 1))
    quiet = F.regexp_replace(_part("onclick"), _NATIVE_BLOCK, "<x-native>")

    def trap(t: Column) -> Column:
        def judge(a: Column) -> Column:
            tab = F.try_to_number(_text(H.attr(a, "tabindex")), F.lit("S999"))
            managed = _text(F.lower(H.attr(a, "role"))).rlike(_ROLE_OK) & (_text(H.attr(a, "tabindex")) == "-1")
            body = H.inner(t)
            words = H.text_of(body)
            ok = (
                ~H.tag_name(t).isin(*_NATIVE) & (F.coalesce(tab, F.lit(-1)) < 0) & ~managed
                & ~body.rlike(r"(?i)<(x-native|input|select|textarea)[\s/>]") & ((words != "") | body.rlike(r"(?i)<(img|svg)[\s/>]"))
            )
            return F.when(ok, F.struct(H.tag_name(t).alias("tag"), H.cut(words, 60).alias("text"), H.selector(H.tag_name(t), a).alias("selector")))

        return let(H.attrs(t), judge)

    traps = F.filter(F.transform(F.regexp_extract_all(quiet, F.lit(_ONCLICK), 0), trap), lambda x: x.isNotNull())
    videos = H.blocks(_part("<video"), "video")
    no_track = F.filter(videos, lambda v: ~F.exists(
        H.tags(v, "track"), lambda t: _text(H.attr(H.attrs(t), "kind")).isin("captions", "subtitles")))
    loud = F.exists(H.tags(_part("<video", "<audio"), "video|audio"), lambda t: let(H.attrs(t), lambda a: H.has_attr(a, "autoplay") & ~(
        (H.tag_name(t) == "video") & H.has_attr(a, "muted"))))
    ui = F.concat(
        _blocks(m, _UI, lambda t, a: H.text_of(H.inner(t))),
        F.transform("tags", lambda t: F.left(F.trim(_text(t["placeholder"])), F.lit(80))),
    )
    return p.select(
        "page_id", "url", "is_entry", "rendered_chars", "text",
        F.length("text").alias("text_length"),
        _text(H.text_of(H.inner(F.get(H.blocks(_part("<title"), "title"), 0)))).alias("title"),
        _text(H.attr(H.attrs(F.get(H.tags(m, "html"), 0)), "lang")).alias("lang"),
        F.get(F.filter("meta", lambda x: x["charset"].isNotNull()), 0)["charset"].alias("charset"),
        named("description").alias("description"),
        named("viewport").alias("viewport"),
        F.exists("meta", lambda x: (x["name"] == "robots") & F.lower(x["content"]).contains("noindex")).alias("noindex"),
        F.exists("meta", lambda x: x["property"] == "og:title").alias("og_title"),
        F.exists("meta", lambda x: x["property"] == "og:image").alias("og_image"),
        F.exists("links", lambda x: F.concat(F.lit(" "), x["rel"], F.lit(" ")).contains(" icon ")).alias("favicon"),
        F.get(F.filter("links", lambda x: x["rel"] == "canonical"), 0)["href"].alias("canonical"),
        F.size(F.filter(levels, lambda x: x == 1)).alias("h1"),
        skips.alias("heading_skips"),
        imgs.alias("images"),
        "anchors", "labels", "ids", "fields",
        nameless_link.alias("nameless_links"),
        nameless_button.alias("nameless_buttons"),
        forms.alias("forms"),
        twice.alias("duplicate_ids"),
        traps.alias("traps"),
        F.when(F.lower("url").startswith("https:"), F.filter(F.transform("tags", lambda t: t["ref"]), lambda r: F.lower(r).startswith("http://")))
        .otherwise(F.array().cast("array<string>")).alias("mixed"),
        _of(_part("<iframe"), "iframe", lambda t, a: F.struct(_text(H.attr(a, "src")).alias("src"), _text(H.attr(a, "title")).alias("title"))).alias("iframes"),
        F.size(no_track).alias("videos_no_captions"),
        loud.alias("autoplay"),
        F.size("tags").alias("nodes"),
        F.size(F.filter("tags", lambda t: t["style"])).alias("inline_styles"),
        F.array_distinct(F.filter(ui, lambda s: (s != "") & (F.length(s) <= 80))).alias("ui"),
    )


# ------------------------------------------------------------------ rules
#: Order numbers a page has for its findings: rules first, images, then spelling.
PAGE_ROOM = 1 << 20


def _finding(rule: int, severity, category: str, title, when: Column, occurrences=1, detail="", element=None, ev=None, fix="") -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("rule"), as_col(severity).alias("severity"), F.lit(category).alias("category"), as_col(title).alias("title"),
            as_col(detail).alias("detail"), as_col(element).cast("string").alias("element"), (G.evidence() if ev is None else ev).alias("evidence"),
            F.lit(fix).alias("how_to_fix"), as_col(occurrences).cast("bigint").alias("occurrences"),
        ),
    )


def _some(name: str) -> Column:
    return F.size(name) > 0


def with_rule_lists(facts: DataFrame) -> DataFrame:
    """Facts with the lists that rules look at several times, each worked out once."""
    no_alt = F.filter("images", lambda i: ~i["alt"])
    blank_rel = F.filter("anchors", lambda a: a["href"].isNotNull() & (a["target"] == "_blank") & ~a["rel"].contains("noopener") & ~a["rel"].contains("noreferrer"))
    hrefless = F.filter("anchors", lambda a: a["href"].isNull())
    orphans = F.filter("labels", lambda l: F.coalesce((l["to"] != "") & ~F.array_contains(F.col("ids"), l["to"]), F.lit(False)))
    label_for = lambda f: F.get(F.filter("labels", lambda l: (f["id"] != "") & (l["to"] == f["id"])), 0)["text"]
    spoken = lambda f: F.coalesce(*[F.nullif(x, F.lit("")) for x in (label_for(f), f["wrap"], f["aria"])], F.lit(""))
    has_label = lambda f: (f["aria"] != "") | (f["labelledby"] != "") | label_for(f).isNotNull() | f["wrap"].isNotNull()
    bare = lambda f: ~has_label(f) & ~f["after_orphan"]
    no_label = F.filter("fields", lambda f: (f["placeholder"] == "") & bare(f))
    ph_only = F.filter("fields", lambda f: (f["placeholder"] != "") & bare(f))
    hint = lambda f: F.coalesce(F.nullif(spoken(f), F.lit("")), F.nullif(f["near"], F.lit("")), f["placeholder"])
    optional = F.filter(
        F.transform(F.filter("fields", lambda f: f["required"]), lambda f: F.struct(hint(f).alias("hint"), f["selector"].alias("selector"))),
        lambda o: o["hint"].rlike(seeds.OPTIONAL_LABEL))
    personal = F.filter("fields", lambda f: ~f["autocomplete"] & (
        f["type"].isin("email", "password", "tel")
        | ((f["type"] == "text") & F.concat_ws(" ", f["name"], f["id"], f["placeholder"], spoken(f)).rlike(seeds.PERSONAL_FIELD))))

    def contact(a: Column) -> Column:
        digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
        listed = F.transform(F.split(F.split_part(F.substr(a["href"], F.lit(8)), F.lit("?"), F.lit(1)), ","),
                             lambda s: F.lower(F.trim(F.url_decode(F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")))))
        targets = F.filter(listed, lambda s: s != "")
        seen = F.transform(F.regexp_extract_all(a["text"], F.lit(_EMAIL), 0), lambda e: F.lower(e))
        wrong = F.filter(seen, lambda e: ~F.array_contains(targets, e))
        mail = F.when((F.size(targets) > 0) & (F.size(wrong) > 0), F.struct(
            F.lit("e-mail address").alias("what"), F.get(wrong, 0).alias("shown"), F.array_join(targets, ", ").alias("opens"), a["selector"].alias("selector")))
        number = F.substr(a["href"], F.lit(5))
        differ = (F.length(digits(a["text"])) >= 7) & (F.length(digits(number)) >= 7) & (
            F.right(digits(a["text"]), F.lit(7)) != F.right(digits(number), F.lit(7)))
        phone = F.when(differ, F.struct(
            F.lit("phone number").alias("what"), a["text"].alias("shown"), number.alias("opens"), a["selector"].alias("selector")))
        return F.when(a["href"].rlike("(?i)^mailto:"), mail).when(a["href"].rlike("(?i)^tel:"), phone)

    contacts = F.filter(F.transform("anchors", contact), lambda x: x.isNotNull())
    no_title = F.filter("iframes", lambda f: f["title"] == "")
    return facts.withColumns({
        "no_alt": no_alt, "blank_rel": blank_rel, "hrefless": hrefless, "orphans": orphans, "no_label": no_label, "ph_only": ph_only,
        "optional": optional, "personal": personal, "contacts": contacts, "no_title": no_title,
    })


def rule_array() -> Column:
    """All page rules over ``with_rule_lists`` as one array of findings, in the order they are reported."""
    c = F.col
    one = lambda *a, **k: F.array(_finding(*a, **k))
    viewport = F.lower(_text(c("viewport")))
    insecure = F.exists("forms", lambda f: F.lower(_text(f["action"])).startswith("http://"))
    junk = F.transform(X.junk_hits(c("text")), lambda j: _finding(
        2, F.when(j["label"].isin(*seeds.JUNK_TEXT_HIGH), "high").otherwise("medium"), "Content",
        F.concat(F.lit("Placeholder / debug text visible to users: "), j["label"]), F.lit(True), ev=G.evidence(excerpt=j["excerpt"]),
        detail="Readers see text that was meant for developers.", fix="Put the real value or text in its place."))
    opt_rows = F.transform("optional", lambda f: _finding(
        19, "medium", "Forms", F.concat(F.lit("Field says optional but the form requires it: '"), F.left(f["hint"], F.lit(50)), F.lit("'")), F.lit(True),
        element=f["selector"], detail="The label promises a choice the form does not give.", fix="Drop the required rule or the word 'optional'."))
    contact_rows = F.transform("contacts", lambda m: _finding(
        21, "medium", "Content", F.concat(F.lit("Contact link opens a different "), m["what"], F.lit(" than it shows")), F.lit(True),
        element=m["selector"], ev=G.evidence(shown=m["shown"], opens=m["opens"]), detail=F.concat(F.lit("Shown "), m["shown"], F.lit(", opens "), m["opens"])))
    first = lambda arr, f="selector": F.get(arr, 0)[f]
    return F.concat(
        one(1, "high", "Content", "Page renders (almost) no text", c("text_length") < 30, detail=F.concat(c("text_length"), F.lit(" characters of text."))),
        junk,
        one(3, "medium", "SEO", "Page has no <title>", c("title") == "", fix="Add a title of its own."),
        one(3, "info", "SEO", "Page title is longer than 65 characters", F.length("title") > 65, ev=G.evidence(title=c("title"))),
        one(4, "low", "SEO", "No meta description", c("description").isNull(), fix="Add a description meta tag."),
        one(4, "low", "SEO", "Meta description is empty", c("description") == "", fix="Fill the description or drop the tag."),
        one(5, "low", "SEO", "Page has no <h1>", c("h1") == 0, fix="Add one top heading."),
        one(5, "info", "SEO", F.concat(F.lit("Page has "), c("h1"), F.lit(" <h1> headings")), c("h1") > 1, fix="Keep one top heading."),
        one(6, "info", "SEO", "No favicon declared", c("is_entry") & ~c("favicon"), fix="Link an icon."),
        one(7, "medium", "SEO", "Page is marked noindex", c("noindex"), fix="Drop noindex where the page is public."),
        one(8, "info", "SEO", "No Open Graph tags", c("is_entry") & ~c("og_title"), fix="Add og:title and its companions."),
        one(9, "low", "Accessibility", "<html> has no lang attribute", c("lang") == "", fix="Declare the language."),
        one(10, "high", "Responsive", "No responsive viewport meta tag", c("viewport").isNull(), fix="Add a viewport meta tag."),
        one(10, "low", "Accessibility", "Viewport meta disables pinch zoom",
            viewport.contains("user-scalable=no") | viewport.rlike(r"maximum-scale=\s*1(\.0)?\b"), ev=G.evidence(viewport=c("viewport"))),
        one(11, "medium", "Accessibility", "Images without an alt attribute", _some("no_alt"), F.size("no_alt"), element=first("no_alt")),
        one(13, "medium", "Accessibility", "Links with no readable text", _some("nameless_links"), F.size("nameless_links")),
        one(14, "low", "Security", "Links open a new tab without rel=noopener", _some("blank_rel"), F.size("blank_rel"), element=first("blank_rel")),
        one(15, "info", "Accessibility", "<a> elements without an href", _some("hrefless"), F.size("hrefless")),
        one(16, "medium", "Accessibility", "Label is not connected to its field", _some("orphans"), F.size("orphans"), ev=G.evidence(points_to=first("orphans", "to"))),
        one(17, "medium", "Accessibility", "Form fields with no label", _some("no_label"), F.size("no_label"), element=first("no_label")),
        one(17, "low", "Accessibility", "Fields rely on placeholder text instead of a label", _some("ph_only"), F.size("ph_only"), element=first("ph_only")),
        one(18, "medium", "Accessibility", "Buttons with no accessible name", _some("nameless_buttons"), F.size("nameless_buttons")),
        opt_rows,
        one(20, "medium", "Accessibility", "Clickable items a keyboard cannot reach", _some("traps"), F.size("traps"), element=first("traps")),
        contact_rows,
        one(22, "low", "Forms", "Personal-data fields give no autocomplete hint", _some("personal"), F.size("personal"), element=first("personal")),
        one(24, "critical", "Security", "Form submits over plain HTTP", insecure, fix="Send the form to an https address."),
        one(25, "low", "HTML Validity", "Duplicate element ids", _some("duplicate_ids"), F.size("duplicate_ids"), ev=G.evidence(ids=F.to_json("duplicate_ids"))),
        one(26, "info", "Accessibility", "Heading levels are skipped", _some("heading_skips"), ev=G.evidence(skips=F.to_json("heading_skips"))),
        one(27, "high", "Security", "Mixed content (http:// resources on an https:// page)", _some("mixed"), F.size("mixed"), ev=G.evidence(resources=F.to_json("mixed"))),
        one(28, "info", "Accessibility", "iframe without a title attribute", _some("no_title"), ev=G.evidence(src=first("no_title", "src"))),
        one(29, "low", "UX", "Media auto-plays with sound", c("autoplay")),
        one(30, "low", "Accessibility", "Videos without captions", c("videos_no_captions") > 0, c("videos_no_captions")),
        one(31, "low", "Performance", F.concat(F.lit("Very large DOM ("), c("nodes"), F.lit(" nodes)")), c("nodes") > 4000),
        one(32, "low", "SEO", "Page content only appears after JavaScript runs",
            c("is_entry") & (c("rendered_chars") >= 600) & (c("text_length") < 150),
            ev=G.evidence(server_html_text_chars=c("text_length"), rendered_text_chars=c("rendered_chars"))),
    )


def findings_of(facts: DataFrame) -> DataFrame:
    """Findings of page facts; ``seq`` orders them by page, then rule."""
    rows = with_rule_lists(facts).select("page_id", "url", F.posexplode(F.filter(rule_array(), lambda f: f.isNotNull())).alias("pos", "f"))
    cols = ["severity", "category", "title", "detail", "element", "evidence", "how_to_fix", "occurrences"]
    return G.shaped_findings(
        rows.select("url", (F.col("page_id") * PAGE_ROOM + F.col("pos")).alias("seq"), "f.*"),
        seq=F.col("seq"), url=F.col("url"), **{c: F.col(c) for c in cols},
    )


def spelling_findings(facts: DataFrame, dictionary: DataFrame) -> DataFrame:
    from webloom.operators.spelling import text_findings

    docs = facts.select(F.struct("page_id", "url").alias("doc_id"), "text", "ui", "lang")
    rows = text_findings(docs, dictionary).select("doc_id.*", "*")
    return G.shaped_findings(
        rows, seq=F.col("page_id") * PAGE_ROOM + PAGE_ROOM // 2 + F.col("place"), severity="low", category="Content", title=F.col("title"),
        detail=F.col("detail"), url=F.col("url"), evidence=G.evidence(word=F.col("word"), suggestion=F.col("suggestion"), times=F.col("times"), context=F.col("context")),
        how_to_fix=F.when(F.col("title").startswith("Same word"), "Choose one spelling and use it throughout.").otherwise("Correct the text where it is kept."),
    )


def page_findings(
    pages: DataFrame, dictionary: DataFrame | None = None, extra: Sequence[Callable[[DataFrame], DataFrame]] = ()
) -> DataFrame:
    """All page rules over captured pages. ``extra``: the caller's own rules, each takes
    page facts and gives findings."""
    facts = page_facts(pages)
    out = findings_of(facts)
    if dictionary is not None:
        out = out.unionByName(spelling_findings(facts, dictionary))
    for rule in extra:
        out = out.unionByName(rule(facts))
    return out


def broken_images(facts: DataFrame, responses: DataFrame) -> DataFrame:
    """Images whose captured response is an error. ``responses``: page_url, url, status."""
    shown = facts.select("page_id", F.col("url").alias("page_url"), F.posexplode("images").alias("pos", "i")).select(
        "page_id", "page_url", "pos", U.resolve("page_url", "i.src").alias("src"), F.col("i.selector").alias("selector")
    )
    bad = responses.where("status >= 400").select("page_url", F.col("url").alias("src")).distinct()
    hit = shown.where("src IS NOT NULL").join(bad, ["page_url", "src"]).groupBy("page_id", "page_url").agg(
        F.count("*").alias("n"), F.min_by("selector", "pos").alias("selector")
    )
    return G.shaped_findings(
        hit, seq=F.col("page_id") * PAGE_ROOM + PAGE_ROOM // 2 - 1, severity="high", category="Broken Media", title="Images that fail to load",
        url=F.col("page_url"), element=F.col("selector"), occurrences=F.col("n"), how_to_fix="Fix the path or restore the file.",
    )


def form_facts(facts: DataFrame) -> DataFrame:
    """One row per form: its fields, signature, password and file marks, submit text."""
    f = F.col("f")
    return facts.select("page_id", "url", F.posexplode("forms").alias("pos", "f")).select(
        "page_id", "url", "pos", "f.action", "f.method", "f.id", "f.name", "f.novalidate", "f.selector", "f.fields",
        f["submit"].isNotNull().alias("has_submit"),
        F.coalesce(H.cut(H.accessible_name(f["submit"]), 60), F.lit("")).alias("submit_text"),
        F.concat(
            F.coalesce(F.when(f["action"] != "", f["action"]), U.path_of("url")), F.lit("::"),
            F.array_join(F.transform(f["fields"], lambda x: F.concat(x["type"], F.lit(":"), x["name"])), ","),
        ).alias("signature"),
        F.exists(f["fields"], lambda x: x["type"] == "password").alias("has_password"),
        F.exists(f["fields"], lambda x: x["type"] == "file").alias("has_file"),
    )
