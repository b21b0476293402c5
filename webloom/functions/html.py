"""Static HTML expressions: a page's tags, attributes and readable text.

Everything stays in the page's own row (arrays and higher-order functions), so
auditing a page needs no shuffle however many pages there are.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.urls import let

ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_HIDDEN_BODY = rf"(?is)<!--.*?-->|<(script|style|noscript|template)\b({ATTRS})>.*?</\1\s*>"
_ATTR = r"""[^\s=>"'/<]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_BLOCK_TAG = (
    r"(?is)</?(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|section|article|header|footer|nav|table|form|"
    r"option|hr|pre|blockquote|dt|dd|main|aside|title|label)(?=[\s/>])" + ATTRS + ">"
)
_ANY_TAG = rf"(?is)</?[a-z]{ATTRS}>"
SPACES = r"(?U)[\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def holding(text: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` where the text holds ``mark``, else the text; it is worked out once."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t))


def cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


# ------------------------------------------------------------------ entities
# names by first letter: a map look-up walks its keys, so the maps stay short
_NAMED = json.dumps(
    {
        letter: {k: v for k, v in html.entities.html5.items() if k[0] == letter}
        for letter in sorted({k[0] for k in html.entities.html5})
    }
)
_COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\u00a0"}
_WINDOWS_1252 = json.dumps([bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)])
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


# characters that would read as markup once decoded wait as non-characters
_MARKUP_CHARS = "<>\"'&"
_WAITING = "﷐﷑﷒﷓﷔"


def _from_code(digits: Column, base: int) -> Column:
    def char(code: Column) -> Column:
        windows = F.get(F.from_json(F.lit(_WINDOWS_1252), "array<string>"), (code - 0x80).cast("int"))
        bad = (F.length(digits) > 8) | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        unseen = code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
        unseen = unseen | code.between(0xFDD0, 0xFDEF)
        return (
            F.when(bad, "�")
            .when(code.between(0x80, 0x9F), windows)
            .when(unseen, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    return let(F.conv(F.left(digits, F.lit(9)), base, 10).cast("long"), char)


def _named(ref: Column, names: Column) -> Column:
    """(text, length) of the longest known name that ``ref`` starts with."""

    def pick(group: Column) -> Column:
        known = lambda n: F.try_element_at(group, F.left(ref, n))
        sizes = F.transform(F.sequence(F.lit(0), F.greatest(F.length(ref) - 2, F.lit(0))), lambda i: F.length(ref) - i)
        return let(
            F.get(F.filter(sizes, lambda n: known(n).isNotNull()), 0),
            lambda n: F.when(n.isNotNull(), F.struct(known(n).alias("text"), n.alias("n"))),
        )

    out = None
    for name, char in _COMMON.items():
        hit = F.struct(F.lit(char).alias("text"), F.lit(len(name)).alias("n"))
        out = F.when(ref == name, hit) if out is None else out.when(ref == name, hit)
    group = F.try_element_at(names, F.left(ref, F.lit(1)))
    return out.otherwise(let(group, lambda g: F.when(g.isNotNull(), pick(g))))


def _reference(piece: Column, names: Column) -> Column:
    """(text, length) of the reference that ``piece`` starts with, null when none."""

    def numeric(ref: Column) -> Column:
        char = F.when(
            ref.rlike("^#[xX]"), _from_code(F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1), 16)
        ).otherwise(_from_code(F.regexp_extract(ref, "([0-9]+)", 1), 10))
        return F.struct(char.alias("text"), F.length(ref).alias("n"))

    return let(
        F.regexp_extract(piece, _REFERENCE, 1),
        lambda ref: F.when(ref.startswith("#"), numeric(ref)).when(ref != "", _named(ref, names)),
    )


def unescape(text: Column, wait: bool = False) -> Column:
    """Character references turned into characters (named, decimal, hex). With
    ``wait`` the ones that would read as markup become stand-ins; see ``plain``."""
    names = F.from_json(F.lit(_NAMED), "map<string,map<string,string>>")
    shown = (lambda c: F.translate(c, _MARKUP_CHARS, _WAITING)) if wait else (lambda c: c)

    def decoded(piece: Column) -> Column:
        return let(
            _reference(piece, names),
            lambda r: F.when(
                r.isNotNull(), F.concat(shown(r["text"]), F.right(piece, F.length(piece) - r["n"]))
            ).otherwise(F.concat(F.lit("&"), piece)),
        )

    def whole(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
        return F.array_join(F.concat(F.slice(pieces, 1, 1), rest), "")

    return holding(text, "&", lambda t: let(F.split(t, "&", -1), whole))


def plain(text: Column) -> Column:
    """Stand-ins of ``markup`` as the characters they are."""
    return F.translate(text, _WAITING, _MARKUP_CHARS)


# ------------------------------------------------------------------ markup
def markup(page: Column) -> Column:
    """HTML without comments and bodies of script-like elements, references
    decoded once for the whole page. Texts taken from it go through ``plain``."""
    emptied = F.regexp_replace(page, _HIDDEN_BODY, "<$1$2></$1>")
    return unescape(F.replace(emptied, F.lit("<></>"), F.lit(" ")), wait=True)


def visible_text(page: Column) -> Column:
    """Readable text of raw HTML before any script runs."""
    t = F.coalesce(page, F.lit(""))
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<head\b.*?</head\s*>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return collapse(unescape(t))


def tags(clean: Column, names: str) -> Column:
    """Open tags, in order; ``names`` is a regex of tag names (``[a-z][^\\s/>]*`` for all)."""
    return F.regexp_extract_all(clean, F.lit(rf"(?is)<(?:{names})(?=[\s/>]){ATTRS}>"), 0)


def blocks(clean: Column, names: str) -> Column:
    """Elements that do not nest in themselves: from the open tag up to the close
    tag, the next open tag of that kind, or the end (unclosed elements are kept)."""
    rx = rf"(?is)<(?:{names})(?=[\s/>]){ATTRS}>.*?(?=</(?:{names})\s*>|<(?:{names})(?=[\s/>])|\z)"
    return F.regexp_extract_all(clean, F.lit(rx), 0)


def open_tag(chunk: Column) -> Column:
    return F.regexp_extract(chunk, rf"(?is)^<[a-z]{ATTRS}>", 0)


def inner(chunk: Column) -> Column:
    return F.regexp_replace(chunk, rf"(?is)^<[a-z]{ATTRS}>", "")


def tag_name(chunk: Column) -> Column:
    return F.lower(F.regexp_extract(chunk, r"^</?([A-Za-z][^\s/>]*)", 1))


def attrs(chunk: Column) -> Column:
    """Attributes of the chunk's open tag: array of (name, value), first one first."""
    body = F.regexp_replace(open_tag(chunk), r"(?s)^<[^\s/>]+|>$", "")
    value = lambda it: F.regexp_replace(
        F.regexp_extract(it, r"(?s)^[^\s=]+\s*=\s*(.*)$", 1), r"""^["']|["']$""", ""
    )
    return F.transform(
        F.regexp_extract_all(body, F.lit(_ATTR), 0),
        lambda it: F.struct(
            F.lower(F.regexp_extract(it, r"^[^\s=]+", 0)).alias("name"), plain(value(it)).alias("value")
        ),
    )


def attr(attributes: Column, name: str) -> Column:
    """Value of an attribute, '' when written without one, null when absent."""
    return F.get(F.filter(attributes, lambda a: a["name"] == name), 0)["value"]


def has_attr(attributes: Column, name: str) -> Column:
    return F.exists(attributes, lambda a: a["name"] == name)


def text_of(chunk: Column) -> Column:
    untagged = lambda t: F.regexp_replace(F.regexp_replace(t, _BLOCK_TAG, " "), _ANY_TAG, "")
    return collapse(plain(holding(chunk, "<", untagged)))


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def selector(name: Column, attributes: Column) -> Column:
    """``#id`` when the id is usable, else the tag with its first two classes."""
    ident = attr(attributes, "id")
    classes = F.filter(F.split(F.coalesce(attr(attributes, "class"), F.lit("")), r"\s+"), lambda c: c != "")
    dotted = F.array_join(F.concat(F.array(name), F.slice(classes, 1, 2)), ".")
    return F.when(ident.rlike(r"^[A-Za-z][\w:.-]*$"), F.concat(F.lit("#"), ident)).otherwise(dotted)


def first_image_alt(chunk: Column) -> Column:
    """Alt text of the first image inside that declares one."""
    alts = F.transform(tags(chunk, "img"), lambda t: attr(attrs(t), "alt"))
    return F.get(F.filter(alts, lambda a: a.isNotNull()), 0)


def accessible_name(chunk: Column) -> Column:
    """aria-label, then text, then title, then an inner image's alt, then an input's value."""
    pick = lambda c: let(F.trim(c), lambda t: F.when(t != "", t))
    is_input = tag_name(chunk) == "input"
    return let(attrs(chunk), lambda a: F.coalesce(
        pick(attr(a, "aria-label")),
        pick(text_of(inner(chunk))),
        pick(attr(a, "title")),
        pick(first_image_alt(inner(chunk))),
        F.when(is_input, pick(attr(a, "value"))),
        F.lit(""),
    ))
