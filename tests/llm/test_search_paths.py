"""Shortcuts of the token cache and of the template search change no result."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from webloom.llm import decontam, tokens

TEXTS = [
    "", None, "   ", "İstanbul Straße. ΟΔΟΣ “Quoted” (Paris), 3rd 12% km. — -- ... x", "A. B? Ünïcode's o'Neil e.g. №5 ª",
    "<|endoftext|> hi <|endoftext|>there 'tis 're foo.\nbar  two  sp\tt x", "Ġ Ġa aĠ", "word\n\nword", "!",
    "Anna has 12 red apples and Bob eats 3 of them on Monday.", "other words before anna has 12 red apples and Bob eats 3 of them",
]


def test_ids_are_those_of_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = tokens.PieceEncoder(path), tokens.load_tokenizer(path)
    for _ in range(2):  # unknown pieces, then known ones
        ids, offsets = own.encode(pa.array(TEXTS))
        for i, text in enumerate(TEXTS):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_word_map_loses_no_matching_window():
    items = pa.array(["Anna has 12 red apples and Bob eats 3 of them on Monday.", "— -- 5 km 7 — Paris 9", "tiny one"])
    docs = pa.array([*TEXTS, "x — -- 8 km 1 — London 2", "see: tiny one"])
    word_map = np.zeros(decontam.MAP_BITS, bool)
    word_map[decontam.Template(items).plain & np.uint64(decontam.MAP_BITS - 1)] = True
    total = 0
    for width in (2, 7, 8):
        wanted = set(decontam.Template(items).windows(width)[1].tolist())
        rows = lambda t: {r for r in zip(*(x.tolist() for x in t.windows(width)), strict=True) if r[1] in wanted}  # noqa: B023, E731
        every, mapped = rows(decontam.Template(docs)), rows(decontam.Template(docs, word_map))
        assert every == mapped
        total += len(every)
    assert total > 5
