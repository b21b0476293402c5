"""Literals of patterns: nothing that matches is ever passed over."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.functions import literals as L


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("jquery[.-]([\\d.]*\\d)[^/]*\\.js", ["jquery"]), ("/wp-(?:content|includes)/", ["/wp-"]), ("(?:foo|barbar)\\d", ["barbar", "foo"]),
        ("(?:foo|b)\\d", []), ("(abc)+x?", ["abc"]), ("(abc)*", []), ("a.c", []), ("Shop(?=ify)\\b pay", ["shop pay"]), ("x{3}yz-", ["yz-"]),
        ("[unclosed", ["[unclosed"]), ("", []), ("Ünder", ["nder"]), ("(?i:CDN)s", ["cdns"]), ("ab(?:cd(?:ef|gh))", ["abcd"]),
    ],
)
def test_required_literals(pattern, want):
    assert L.required_literals(pattern) == want


PIECES = st.sampled_from(["ab", "K", "s", "İ", "ſ", "K", "i", "ı", "(?:abc|xyz)", "(ab|c)", "x+", "(?:sik)*", "[a-c]", ".", "\\b", "(?=s)", "ski", "(?!k)", "a{2,3}", "|"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=6), st.text(st.sampled_from("abckKsSiIxyzİſKı"), max_size=14))
def test_a_match_is_never_passed_over(pieces, text):
    pattern = "".join(pieces)
    book = L.PatternBook([("it", pattern)])
    assert book.found(text) == ({"it"} if re.compile(pattern, re.IGNORECASE).search(text) else set())


def test_many_patterns_cost_little_more_than_few():
    text = "<script src='/static/lib-17.min.js'></script> generator 77 " * 400
    books = {n: L.PatternBook([(f"t{i}", f"lib-{i}\\.(?:min\\.)?js") for i in range(n)]) for n in (200, 20_000)}
    spent = {}
    for n, book in books.items():
        assert book.found(text) == {"t17"} and len(book.candidates(text)) <= 2
        start = time.process_time()
        for _ in range(20):
            book.found(text)
        spent[n] = time.process_time() - start
    assert spent[20_000] < 3 * spent[200] + 0.05
