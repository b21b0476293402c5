"""Operators that work batch by batch in tasks, held to brute force without Spark."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from webloom.llm import decontam, langid, lm, minhash, packing, pii, quality, substring
from webloom.llm.arrow_text import slices, split_words, window_hashes
from webloom.llm.tokens import PieceEncoder, load_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["  a\x0b\x1cb  c ", "", None, " \t\n", "Éa b c D", "x" * 5000, "one two three four five six one two three four five"]
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("lower", [False, True])
def test_words(lower):
    words = split_words(pa.array(TEXTS), lower)
    names = words.dictionary.to_pylist()
    for i, t in enumerate(TEXTS):
        want = WORD.findall(t or "")
        if lower:
            want = [w.translate({c: c + 32 for c in range(65, 91)}) for w in want]
        assert [names[c] for c in words.codes[words.offsets[i] : words.offsets[i + 1]]] == want


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS * 50), "n": pa.array(range(len(TEXTS) * 50))})
    parts = list(slices(iter([batch]), size=3000))
    assert len(parts) > 3
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(len(TEXTS) * 50))


def test_window_hashes_tell_windows_apart():
    draw = np.random.RandomState(1).randint(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 5, 7, 16, 35):
        got = window_hashes(draw, width)
        seen = {}
        for i in range(400 - width + 1):
            assert seen.setdefault(tuple(draw[i : i + width]), got[i]) == got[i]
        assert len(set(seen.values())) == len(seen)


def test_tokens_equal_the_tokenizer():
    texts = ["  a b", "a  b", " a", "a ", "", "x y, z.\nNext (one)", "x\n y", "<|endoftext|> a", "it's a'll b", "a²b c\td", "a 　b", None, "Ünï cödé, und ÄÖ!"]
    tokenizer = load_tokenizer(BPE)
    encoder = PieceEncoder(BPE)
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing_round_trip():
    draw = np.random.RandomState(3)
    texts = [" ".join(draw.choice(["the", "of", "uncommonly", "x1", "é"], n)) for n in draw.randint(0, 900, 60)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    rows = [r for b in packing.pack_task(iter([batch]), BPE, 256, 1) for r in b.to_pylist()]
    tokenizer = load_tokenizer(BPE)
    for d, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        size = sum(r["length"] for r in own)
        assert size <= 256 and size & (size - 1) == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_plain_spans_equal_the_patterns():
    draw = np.random.RandomState(5)
    parts = ["a", "b.", "@", ".", "-", " ", "+", "1", "22", "255", "256", "(", ")", "4041894974608795", "x@y.zz", "+1 (988) 555-2485", "1.2.3.4", "é"]
    for _ in range(3000):
        text = "".join(draw.choice(parts, draw.randint(1, 12)))
        assert pii.plain_spans(text) == brute_spans(text), text


def test_hidden_spans():
    def found(text):
        plain = pii.plain_spans(text)
        return [(pii.KINDS[k], text[s:e]) for k, s, e in pii.hidden_spans(text, plain)]

    assert found("mail john [at] example (dot) com now") == [("email", "john [at] example (dot) com")]
    assert found("john dot doe at example dot com, look at example.com") == [("email", "john dot doe at example dot com")]
    assert found("ｊohn@exаmple.com") == [("email", "ｊohn@exаmple.com")]
    assert found("4111​1111​1111​1111") == [("card", "4111​1111​1111​1111")]
    assert found("four" + " one" * 15 + " x") == [("card", "four" + " one" * 15)]
    assert found("call plus four four one one five five five six six six nine") == [("phone", "plus four four one one five five five six six six nine")]
    assert found("Look at the one. Two or three at home dot.") == []
    assert found("") == []


def test_quality_statistics():
    text = "a b c d e\na b c d e\n\n#x $\nz"
    got = {n: c.to_pylist() for n, c in quality.text_stats(pa.array([text, None, " \n "])).items()}
    assert got["n_words"] == [13, 0, 0]
    assert got["word_chars"] == [14, 0, 0]
    assert got["n_symbols"] == [2, 0, 0]
    assert got["n_dup_lines"] == [1, 0, 0]
    assert got["n_repeat_words"] == [10, 0, 0]
    assert [len(x) for x in got["lines"]] == [4, 0, 0]
    gone = {got["lines"][0][0]}
    assert quality.strip_lines(text, gone) == "\n#x $\nz"


def test_shingle_sets():
    texts = ["A b c d e f", "a b c d e f", "a b", "A  B", "a b c", "", None]
    keys, offsets = minhash.shingle_sets(pa.array(texts))
    sets = [tuple(keys[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 0, 0]
    assert sets[0] == sets[1] and sets[2] == sets[3] and sets[2] != sets[4]


def test_every_pair_within_the_distance_meets():
    draw = np.random.RandomState(9)
    for errors in (0, 7, 16, minhash.MAX_DISTANCE):
        one = draw.randint(0, 2**16, (200, minhash.HASHES)).astype(np.uint16)
        two = one.copy()
        for row in two:
            row[draw.choice(minhash.HASHES, errors, replace=False)] ^= 1
        a, _ = minhash.bucket_keys(one, list(range(minhash.CHUNKS)))
        b, _ = minhash.bucket_keys(two, list(range(minhash.CHUNKS)))
        assert (a == b).any(1).all()


def test_anchors_cover_every_run():
    draw = np.random.RandomState(2)
    texts = [" ".join(draw.choice(list("abcdef"), n)) for n in (0, 10, 34, 35, 36, 300)] + ["a " * 100]
    words = split_words(pa.array(texts))
    starts, anchors, places, marks = substring.runs_of(words, 35, 17)
    want = [o + i for o, n in zip(words.offsets[:-1], words.counts, strict=True) for i in range(max(0, n - 34))]
    assert starts.tolist() == want
    for s, anchor in zip(starts, anchors, strict=True):
        inside = (places >= s) & (places <= s + 18)
        assert anchor in marks[inside]


def test_templates_and_slots():
    t = decontam.Template(pa.array(["The train with Anna left 12 km away. Then it stopped."]))
    assert [int(k) for k in t.kinds] == [0, 0, 0, decontam.NAME, 0, decontam.NUM, decontam.UNIT, 0, 0, 0, 0]
    assert t.slots(3, 4) == ["anna", "12", "km"]
    other = decontam.Template(pa.array(["the train with Bob left 99 miles away. Then it stopped."]))
    assert (t.hashes == other.hashes).all()


def test_mixture_finds_both_languages():
    a, b = np.array([0.7, 0.1, 0.1, 0.1]), np.array([0.1, 0.1, 0.1, 0.7])
    p = np.stack([a, b], 1).astype(np.float32)
    assert np.argmax(langid.mixture(p, (a * 1000).astype(int))) == 0
    share = langid.mixture(p, ((a + b) * 500).astype(int))
    assert abs(share[0] - 0.5) < 0.05
    assert langid.mixture(p, (a * 1000).astype(int))[1] == 0  # the second leaves the set


def test_gradients_of_the_model():
    draw = np.random.RandomState(4)
    m = {n: w.astype(np.float64) for n, w in lm.fresh_model(draw.randint(0, 50, lm.CLASSES)).items()}
    windows = draw.randint(0, lm.CLASSES, (3, lm.CONTEXT + 1))
    weight = np.ones((3, lm.CONTEXT))
    g, _ = lm.gradients(m, windows[:, :-1], windows[:, 1:], weight)
    for n in lm.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(g[n])), g[n].shape)
        ends = []
        for step in (1e-4, -2e-4):
            m[n][at] += step
            ends.append(lm.gradients(m, windows[:, :-1], windows[:, 1:], weight)[1])
        m[n][at] += 1e-4
        assert abs((ends[0] - ends[1]) / 2e-4 - g[n][at]) <= 0.02 * abs(g[n][at]) + 1e-7


def test_each_token_is_scored_once():
    draw = np.random.RandomState(6)
    m = lm.fresh_model(draw.randint(1, 50, lm.CLASSES))
    for n in ("q", "k", "v", "o", "up", "down", "out", "group", "embed", "place"):
        m[n][:] = 0  # without weights each token has its unigram probability
    sizes = [2, 3, 31, 33, 34, 100]
    classes = draw.randint(0, lm.CLASSES, sum(sizes))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    got = lm.sequence_scores(m, classes, np.zeros(len(classes), np.float32), offsets)
    share = m["group_bias"][:, None] + m["bias"]
    for d in range(len(sizes)):
        want = share.ravel()[classes[offsets[d] + 1 : offsets[d + 1]]].sum() / np.log(10)
        assert abs(got[d] - want) < 1e-3 * abs(want)
