"""Sum-of-squares online packing of token sequences.

Every task packs the documents of its own partition as they come. A document's full
windows leave at once; what is left of it goes to the fill level that makes the sum of
the squared numbers of partially filled windows, kept in one array by level, smallest
(ties: the fullest window). Windows leave when they are full. At the end of a partition
the few open windows are laid out again, cut to full windows, and the last remainder is
cut to powers of two, which need no padding. No shuffle; memory is the open windows.

Defined cases: a null or empty text is the end id alone; every row is packed, repeated
rows too; texts of any length leave window by window; a sequence number holds the
partition in its upper bits, so no two tasks share one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from webloom.llm.arrow_text import slices
from webloom.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class LevelPacker:
    """Windows under construction. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, first_sequence: int):
        self.window = window
        self.next = first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.levels = np.arange(window)

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Places a piece shorter than a window; gives the rows of a window it fills."""
        size, counts, window = len(piece[2]), self.counts, self.window
        usable = np.flatnonzero(counts[: window - size + 1])
        level = 0
        if len(usable):
            gain = -2 * counts[usable] + 1 + np.where(usable + size < window, 2 * counts[np.minimum(usable + size, window)] + 1, 0)
            best = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if gain[best] <= 2 * counts[size] + 1:
                level = int(usable[best])
        held = []
        if level:
            held = self.open[level].pop()
            counts[level] -= 1
        held.append(piece)
        if level + size == window:
            yield from self.leave(held)
        else:
            self.open[level + size].append(held)
            counts[level + size] += 1

    def leave(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, tokens in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.next, offset
            offset += len(ids)
        self.next += 1

    def close(self) -> Iterator[tuple]:
        """Lays the open windows out again: full ones, then powers of two."""
        left = [p for level in reversed(self.open) for held in level for p in held]
        total = sum(len(p[2]) for p in left)
        sizes = [self.window] * (total // self.window) + [1 << b for b in range(self.window.bit_length(), -1, -1) if total % self.window >> b & 1]
        at, piece = 0, 0
        for size in sizes:
            held = []
            while size:
                doc, start, ids, tokens = left[piece]
                got = ids[at : at + size]
                held.append((doc, start + at, got, tokens))
                size -= len(got)
                at += len(got)
                if at == len(ids):
                    at, piece = 0, piece + 1
            yield from self.leave(held)


def pack_task(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    packer = LevelPacker(window, (context.partitionId() if context else 0) << 36)
    schema = None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
        return pa.RecordBatch.from_pydict({n: pa.array(c, schema if n == "doc_id" else pa.int64()) for n, c in zip(FIELDS, columns, strict=True)})

    for part in slices(batches):
        schema = part.schema.field("doc_id").type
        ids, offsets = encoder(path).encode(part.column("text"))
        rows: list[tuple] = []
        for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
            full = len(own) // window * window
            for start in range(0, full, window):
                rows += packer.leave([(doc, start, own[start : start + window], len(own))])
            if full < len(own):
                rows += packer.add((doc, full, own[full:], len(own)))
        yield batch(rows)
    if schema is not None:
        yield batch(list(packer.close()))


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset). ``window`` must be a power of two."""
    some = docs.select("doc_id", "text")
    kind = some.schema["doc_id"].dataType.simpleString()
    return some.mapInArrow(lambda it: pack_task(it, tokenizer_path, window, end_id), f"doc_id {kind}, {SCHEMA}")
