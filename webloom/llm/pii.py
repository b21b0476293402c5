"""Personal data in texts, with offset-preserving deobfuscation.

Two passes over each whole text. The plain pass finds emails, addresses, card and phone
numbers as they stand. The second pass runs transducers over the text that write a
normalised copy together with the source place of every character they write:

* homoglyphs: full-width forms, Cyrillic and Greek look-alikes, digits of other scripts;
  zero-width characters and soft hyphens write nothing;
* disguises: ``[at]``, ``(dot)``, ``{at}`` and, in a run that reads like an address, ``name at host
  dot tld`` (any word of SIGNS, any ending of two letters or more) become ``@`` and ``.``; "at this
  point in" or "at the dot of" is prose;
* spelled digits: a run of at least ``MIN_SPELLED`` number words, or of any number of them next
  to digits, becomes digits.

Identifiers found in the copy are mapped back to source characters. Plain spans always
stay; a mapped span is added only where it lies on source that a transducer changed and
that no plain span of its kind covers, so plain texts get exactly their plain spans.

Defined cases: a null or empty text has no spans; offsets are code points, end exclusive;
repeated rows get equal results each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.arrow_text import slices

KINDS = ("email", "ip", "card", "phone")
#: Number words that must stand in a row before they count as digits where no digit stands with them.
MIN_SPELLED = 4

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+", re.ASCII)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Number words of the languages in use.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Letters of other scripts that look like Latin ones, position by position.
LOOKS = "авесморрхукіјѕһԁԛԝАВЕКМНОРСТХІЈЅοαινρυΑΒΕΗΙΚΜΝΟΡΤΥΧΖ"
LATIN = "abecmoppxykijshdqwABEKMHOPCTXIJSoaivpuABEHIKMNOPTYXZ"

INVISIBLE = "­​‌‍⁠﻿"
SPELLED = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED_RUN = re.compile(
    rf"(?<![^\W_])(?:{SPELLED}|[0-9]+)(?:[ ,.\-]{{1,3}}(?:{SPELLED}|[0-9]+)(?![^\W_]))+", re.IGNORECASE)
ANY_DIGIT = re.compile("[0-9]")
NUMBER_WORD = re.compile(rf"(?<![^\W_])(?:{SPELLED})(?![^\W_])", re.IGNORECASE)
BRACKETED = re.compile(r"\s?([\[({<])\s?(at|dot|punkt|point|punto|arroba|[@.])\s?[\])}>]\s?", re.IGNORECASE)
SPOKEN_DOT = re.compile(r"(?<=[0-9])\s+dot\s+(?=[0-9])", re.IGNORECASE)
SPOKEN_PLUS = re.compile(r"(?:\+|(?<![^\W_])plus)\s+(?=[0-9])", re.IGNORECASE)
#: Letters that stand for digits between two digits.
LETTER_DIGIT = re.compile(r"(?<=[0-9])[OolI](?=[0-9])")
DOT = r"(?:\s{1,3}(?:dot|punkt|point|punto)\s{1,3}|\.)"
SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,6}}(?:\s{{1,3}}(?:at|arroba)\s{{1,3}}|@)"
    rf"(?!(?:this|that|the|a|any|some|one|no|each|every|which|what|another)\s+(?:point|dot)\s)[A-Za-z0-9-]{{1,63}}"
    rf"(?:{DOT}[A-Za-z0-9-]{{1,63}}){{0,6}}{DOT}[A-Za-z]{{2,63}}(?![A-Za-z0-9-])", re.IGNORECASE)
SPOKEN_PART = re.compile(r"\s+(at|arroba|dot|punkt|point|punto)\s+", re.IGNORECASE)
SIGNS = {"@": "@", ".": ".", "at": "@", "arroba": "@", "dot": ".", "punkt": ".", "point": ".", "punto": "."}


@cache
def homoglyphs() -> dict[int, str | None]:
    """Code point to the plain character it stands for; None writes nothing."""
    out: dict[int, str | None] = dict(zip(map(ord, LOOKS), LATIN, strict=True)) | {ord(c): None for c in INVISIBLE}
    out |= {0xFF00 + i: chr(0x20 + i) for i in range(1, 95)}
    for c in range(0x0660, 0x1FC00):
        if unicodedata.category(chr(c)) == "Nd":
            out.setdefault(c, str(unicodedata.decimal(chr(c))))
    return out | {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-", 0x00A0: " ", 0x202F: " ", 0x3002: ".", 0x2024: ".", 0xFE6B: "@"}


@cache
def odd_characters() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, map(chr, homoglyphs()))) + "]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all plain identifiers, by kind, then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    if not re.search("[0-9]", text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


class Tape:
    """A text under transduction: its characters and, for each, the source span it came from.
    ``changed`` marks characters that a transducer wrote."""

    def __init__(self, text: str):
        self.text = text
        n = len(text)
        self.start = np.arange(n, dtype=np.int64)
        self.end = self.start + 1
        self.changed = np.zeros(n, bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces the spans (start, end, written), which are in order and apart."""
        text, starts, ends, marks, at = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            marks += [self.changed[at:a], np.ones(len(new), bool)]
            if not new and a:
                marks[-2] = marks[-2].copy()
                if len(marks[-2]):
                    marks[-2][-1] = True
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start = np.concatenate([*starts, self.start[at:]])
        self.end = np.concatenate([*ends, self.end[at:]])
        self.changed = np.concatenate([*marks, self.changed[at:]])


def fold_homoglyphs(tape: Tape) -> None:
    table = homoglyphs()
    edits = [(m.start(), m.end(), table[ord(m.group())] or "") for m in odd_characters().finditer(tape.text)]
    if edits:
        tape.rewrite(edits)


def fold_digits(tape: Tape) -> None:
    edits = []
    for run in SPELLED_RUN.finditer(tape.text):
        words = list(NUMBER_WORD.finditer(tape.text, run.start(), run.end()))
        if not words or len(words) < MIN_SPELLED and not ANY_DIGIT.search(run.group()):
            continue
        last = None
        for m in re.finditer(rf"{SPELLED}|[0-9]+", run.group(), re.IGNORECASE):
            a, b = run.start() + m.start(), run.start() + m.end()
            if last is not None and a > last:
                edits.append((last, a, ""))
            edits.append((a, b, DIGIT_WORDS.get(m.group().lower(), m.group())))
            last = b
    if edits:
        tape.rewrite(edits)
    edits = [(m.start(), m.end(), "+") for m in SPOKEN_PLUS.finditer(tape.text)]
    if edits:
        tape.rewrite(edits)


def fold_letters(tape: Tape) -> None:
    edits = [(m.start(), m.end(), "0" if m.group() in "Oo" else "1") for m in LETTER_DIGIT.finditer(tape.text)]
    if edits:
        tape.rewrite(edits)


def fold_signs(tape: Tape) -> None:
    edits = [(m.start(), m.end(), SIGNS[m.group(2).lower()]) for m in BRACKETED.finditer(tape.text)]
    if edits:
        tape.rewrite(edits)
    edits = [(m.start(), m.end(), ".") for m in SPOKEN_DOT.finditer(tape.text)]
    if edits:
        tape.rewrite(edits)
    edits = []
    for run in SPOKEN.finditer(tape.text):
        parts = list(SPOKEN_PART.finditer(tape.text, run.start(), run.end()))
        if any(SIGNS[m.group(1).lower()] == "." for m in parts):  # "look at example.com" is prose
            edits += [(m.start(), m.end(), SIGNS[m.group(1).lower()]) for m in parts]
    if edits:
        tape.rewrite(edits)


#: A text none of these occur in is left as it is by every transducer.
SPOKEN_SIGN = re.compile(r"\b(?:dot|arroba|punkt|point|punto)\b|[\[({<]\s*(?:at|punkt|point|punto|[@.])\s*[\])}>]", re.IGNORECASE)


def hidden_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the transduced text shows, as source spans."""
    tape = Tape(text)
    if not text.isascii():
        fold_homoglyphs(tape)
    if NUMBER_WORD.search(tape.text):
        fold_digits(tape)
    if LETTER_DIGIT.search(tape.text):
        fold_letters(tape)
    if SPOKEN_SIGN.search(tape.text):
        fold_signs(tape)
    if not tape.changed.any():
        return []
    taken = {k: [(s, e) for kind, s, e in plain if kind == k] for k in range(len(KINDS))}
    out = []
    for kind, a, b in plain_spans(tape.text):
        if not tape.changed[a:b].any():
            continue
        start, end = int(tape.start[a]), int(tape.end[b - 1])
        if all(end <= s or e <= start for s, e in taken[kind]):
            out.append((kind, start, end))
    return out


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:long,end:long,plain:boolean>>"
)
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found")}
        for text in part.column("text").to_pylist():
            text = text or ""
            plain = plain_spans(text)
            every = sorted(plain + hidden_spans(text, plain))
            for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                rows[name].append(sum(x[0] == k for x in plain))
            rows["base_sha256"].append(hashlib.sha256(digest_text(plain).encode()).hexdigest())
            rows["spans"].append(digest_text(every))
            known = set(plain)
            rows["found"].append([{"kind": KINDS[k], "start": s, "end": e, "plain": (k, s, e) in known} for k, s, e in every])
        kinds = {"base_sha256": pa.string(), "spans": pa.string(), "found": FOUND}
        yield pa.RecordBatch.from_pydict(
            {"doc_id": part.column("doc_id")} | {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in rows.items()})


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts and digest of the plain spans, all
    spans as text, and ``found`` with every span (source code points). One scan, no shuffle."""
    some = docs.select("doc_id", "text")
    return some.mapInArrow(_scan, f"doc_id {some.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
