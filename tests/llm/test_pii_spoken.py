"""Spoken addresses of any ending and language, digits partly spelled."""

import pytest

from webloom.llm import pii


def found(text):
    return [(pii.KINDS[k], text[s:e]) for k, s, e in pii.hidden_spans(text, pii.plain_spans(text))]


@pytest.mark.parametrize("address", [
    "jane at mail dot nl", "jane at mail dot it", "jane at mail dot co dot uk", "jane dot doe at mail.ch", "jane at mail dot museum",
    "maria arroba ejemplo punto es", "hans at beispiel punkt de", "jean at exemple point fr"])
def test_spoken_addresses(address):
    assert found(f"({address}), please") == [("email", address)]


@pytest.mark.parametrize("kind,number", [
    ("phone", "+1 555 010 four two"), ("phone", "+1 (555) 010 four two"), ("card", "4111 1111 1111 1 one one one"), ("card", "4111111111111 one one one")])
def test_digits_partly_spelled(kind, number):
    assert found(f"call {number} now") == [(kind, number)]


@pytest.mark.parametrize("text", [
    "we looked at this point in time", "look at the dot there", "she was 4, two of them were 7 and one 12", "le point 3 est un point", "en punto de 4 dos"])
def test_prose(text):
    assert found(text) == []
