"""Subword ids of whole texts, a batch at a time.

Byte-level pair encoders never join characters across a single space between two visible
characters, so a text falls into pieces there and each distinct piece is encoded once per
task. Texts in which white space stands next to a space are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a task remembers; beyond that it starts anew. Only speed depends on it.
CACHE_PIECES = 600_000
#: White space next to a space, or a space at an end.
UNSAFE = "^ | $|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}] | [\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"

#: The letter that stands for a space in the vocabulary of byte-level encoders.
SPACE = "\u0120"
#: Letters, then punctuation, then the end or a new line.
SEAM = re.compile(r"( ?[^\W\d_]+)([^\w\s]+)(\n.*)?", re.DOTALL)


@cache
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def gather(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``buffer[starts[i] : starts[i] + lengths[i]]`` one after another."""
    before = np.cumsum(lengths) - lengths
    return buffer[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class PieceEncoder:
    """Encodes batches of texts; remembers the ids of the pieces it has met."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[0:1] == SPACE]] = True
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = array("I")
        self.bounds = array("q", [0])

    def learn(self, pieces: list[str]) -> None:
        """Encodes unknown pieces. Those that start with a space are encoded as one text: no id
        joins across it, and the only ids that begin with a space begin a piece."""
        spaced = [p for p in pieces if p[0:1] == " " and p[1:2].strip() and p[-1].strip()]
        if len(spaced) < len(pieces):
            some = set(spaced)
            self.learn_singly([p for p in pieces if p not in some])
        known, ids, bounds = self.known, self.ids, self.bounds
        for i in range(0, len(spaced), 4096):
            some = spaced[i : i + 4096]
            got = np.asarray(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.opens[got])
            if len(starts) != len(some) or starts[0] != 0:
                self.learn_singly(some)
                continue
            known.update(zip(some, range(len(bounds) - 1, len(bounds) - 1 + len(some)), strict=True))
            ends = np.append(starts[1:], len(got)) + len(ids)
            ids.frombytes(got.tobytes())
            bounds.frombytes(ends.astype(np.int64).tobytes())

    def learn_singly(self, pieces: list[str]) -> None:
        known, ids, bounds = self.known, self.ids, self.bounds
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[piece] = len(bounds) - 1
                ids.extend(e.ids)
                bounds.append(len(ids))

    def places(self, pieces: list[str]) -> np.ndarray:
        """Number of each piece among the known ones; unknown ones are encoded first, in
        parts where letters end before punctuation, as such a place is always a seam."""
        known = self.known
        found = list(map(known.get, pieces))
        fresh = [p for p, at in zip(pieces, found, strict=True) if at is None]
        if not fresh:
            return np.array(found, np.int64)
        if len(known) + len(fresh) > CACHE_PIECES and known:
            self.reset()
            known, fresh = self.known, pieces
        # a piece whose characters after the first are letters holds no punctuation
        mixed = [p for p in fresh if not p[1:].isalpha()]
        seams = {p: [g for g in m.groups() if g] for p in mixed if (m := SEAM.fullmatch(p))}
        parts = {g for groups in seams.values() for g in groups}
        self.learn([p for p in fresh if p not in seams and p not in parts] + [g for g in parts if g not in known])
        ids, bounds = self.ids, self.bounds
        for piece, groups in seams.items():
            for g in groups:
                at = known[g]
                ids.extend(ids[bounds[at] : bounds[at + 1]])
            known[piece] = len(bounds) - 1
            bounds.append(len(ids))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ``ids[offsets[i]:offsets[i + 1]]``; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        coded = lists.flatten().dictionary_encode()
        first = np.zeros(ends[-1], bool)
        first[ends[:-1][np.diff(ends) > 0]] = True
        both = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + first
        kinds, index = np.unique(both, return_inverse=True)
        strings = coded.dictionary.to_pylist()
        pieces = [strings[k >> 1] if k & 1 else " " + strings[k >> 1] for k in kinds.tolist()]
        at = self.places(pieces)
        bounds = np.array(self.bounds)
        starts, lengths = bounds[at][index], np.diff(bounds)[at][index]
        ids = gather(np.array(self.ids, dtype=np.uint32), starts, lengths)
        offsets = np.concatenate(([0], np.cumsum(lengths)))[ends]
        if not whole.any():
            return ids, offsets
        parts, counts = [], np.diff(offsets)
        for i in range(len(texts)):
            if whole[i]:
                got = np.asarray(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
                counts[i] = len(got)
                parts.append(got)
            else:
                parts.append(ids[offsets[i] : offsets[i + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
