"""Literals that a text must hold before a regular expression can match it."""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick

#: Shorter literals stand in nearly every text and tell nothing.
LEAST = 3
#: Letters outside of ASCII that match an ASCII letter when case does not count.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}

_P = re._parser
_REPEATS = (_P.MAX_REPEAT, _P.MIN_REPEAT, _P.POSSESSIVE_REPEAT)


def folded(text: str) -> str:
    """The text as its literals are looked up: a case-blind match of an ASCII literal is one here."""
    return text.translate(ALIKE).lower()


def required_literals(pattern: str) -> list[str]:
    """Literals of which a text that the case-blind pattern matches holds one at least; none when
    nothing can be said. A pattern that does not compile stands for its own text."""
    try:
        parts = _P.parse(pattern, re.IGNORECASE)
    except re.error:
        return [low] if pattern.isascii() and len(low := pattern.lower()) >= LEAST else []
    return _of(parts) or []


def _of(parts) -> list[str] | None:
    """The best choice for a sequence: its longest literal, or the literals of a choice in it."""
    runs, choices = [""], []

    def walk(items) -> None:
        for op, value in items:
            if op is _P.LITERAL and 32 <= value < 127:
                runs[-1] += chr(value).lower()
            elif op is _P.SUBPATTERN:
                walk(value[3])
            elif op is _P.ATOMIC_GROUP:
                walk(value)
            elif op in (_P.AT, _P.ASSERT, _P.ASSERT_NOT):
                continue  # takes no character, so what stands around it is joined
            else:
                runs.append("")
                if op in _REPEATS and value[0] > 0:
                    walk(value[2])
                    runs.append("")
                elif op is _P.BRANCH:
                    each = [_of(branch) for branch in value[1]]
                    if all(each):
                        choices.append(sorted({text for some in each for text in some}))

    walk(parts)
    best = max(runs, key=len)
    if len(best) >= LEAST:
        return [best]
    return max(choices, key=lambda c: min(map(len, c)), default=None)


class PatternBook:
    """Case-blind patterns under names; a text meets only those whose literal it holds.

    One automaton finds the literals of all patterns in one pass; patterns without one are tried on
    every text. A pattern is compiled when it is first tried.
    """

    def __init__(self, named: Iterable[tuple[str, str]]):
        self.named = list(named)
        self.compiled: dict[int, re.Pattern] = {}
        self.always: list[int] = []
        by_literal: dict[str, list[int]] = {}
        for i, (_, pattern) in enumerate(self.named):
            literals = required_literals(pattern)
            for text in literals:
                by_literal.setdefault(text, []).append(i)
            if not literals:
                self.always.append(i)
        self.known = ahocorasick.Automaton()
        for text, owners in by_literal.items():
            self.known.add_word(text, owners)
        if by_literal:
            self.known.make_automaton()

    def pattern(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            text = self.named[i][1]
            try:
                self.compiled[i] = re.compile(text, re.IGNORECASE)
            except re.error:
                self.compiled[i] = re.compile(re.escape(text), re.IGNORECASE)
        return self.compiled[i]

    def candidates(self, text: str) -> set[int]:
        out = set(self.always)
        if len(self.known):
            for _, owners in self.known.iter(folded(text)):
                out.update(owners)
        return out

    def found(self, text: str, but: set[str] = frozenset()) -> set[str]:
        """Names of the patterns found in the text; those of ``but`` are not looked for."""
        out: set[str] = set()
        for i in self.candidates(text):
            name = self.named[i][0]
            if name not in but and name not in out and self.pattern(i).search(text) is not None:
                out.add(name)
        return out
