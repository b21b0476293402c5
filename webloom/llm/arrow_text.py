"""Arrow and numpy helpers for the tasks that read whole texts.

A batch of texts becomes one flat array of word codes with the place of each
document in it, so that counting and hashing work on whole arrays instead of on
single words. Words are ``[^\\x20\\x09-\\x0D]+`` everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text a task works on at a time; one longer text is a slice by itself.
SLICE_BYTES = 4 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``size`` bytes of ``column``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            # a copy: some Arrow kernels misread arrays that start inside a buffer
            yield batch.take(pa.array(np.arange(start, stop)))
            start = stop


@dataclass
class Words:
    """Words of a batch: ``codes`` index ``dictionary``; document d owns ``codes[offsets[d]:offsets[d + 1]]``."""

    codes: np.ndarray
    offsets: np.ndarray
    dictionary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text; a null text has none. ``lower`` turns A-Z into a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    dictionary = coded.dictionary
    if lower:
        low = pc.ascii_lower(dictionary).dictionary_encode()
        codes, dictionary = low.indices.to_numpy(zero_copy_only=False)[codes], low.dictionary
    empty = np.flatnonzero(pc.binary_length(dictionary).to_numpy(zero_copy_only=False) == 0)
    if len(empty):
        keep = codes != empty[0]
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return Words(codes, offsets, dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of the strings, the same in every task."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s) for s in strings.to_pylist()), dtype=np.uint64, count=len(strings))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of ``width`` values: entry i covers ``i .. i + width - 1``.

    The runs of a doubling table are combined, so the cost grows with the logarithm
    of the width. Runs over a document's end are the caller's to leave out.
    """
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    done, total, span, power = 0, None, 1, mix(hashes + np.uint64(seed * int(MIX) % 2**64))
    left = width
    while left:
        if left & 1:
            part = power[done : done + len(hashes) - width + 1]
            total = part.copy() if total is None else mix(total * MIX + part)
            done += span
        left >>= 1
        if left:
            power = mix(power[:-span] * MIX1 + power[span:])
            span *= 2
    return total


def window_starts(offsets: np.ndarray, width: int, total: int) -> np.ndarray:
    """True where a run of ``width`` words starts that ends in the same document."""
    ok = np.zeros(total + 1, np.int32)
    counts = np.diff(offsets)
    has = counts >= width
    np.add.at(ok, offsets[:-1][has], 1)
    np.add.at(ok, offsets[1:][has] - width + 1, -1)
    return np.cumsum(ok[:total]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind=pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
