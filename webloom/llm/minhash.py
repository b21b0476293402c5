"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

Signature. A document's set is its distinct five-word shingles. ``HASHES`` minima are
kept with their lowest ``BITS`` bits; two documents of similarity s differ in a share
1 - s of the places (up to 2^-BITS).

Join. The places fall into ``CHUNKS`` chunks. For a distance threshold t the pigeonhole
principle gives t = CHUNKS * r + e: one of the first e + 1 chunks differs in at most r
places or one of the others in at most r - 1. Allowed errors are enumerated by leaving
places out: a chunk with r allowed errors is indexed once for each choice of r places left
out. So every pair with distance <= ``MAX_DISTANCE`` meets in some bucket. Pairs beyond it
mostly meet too: at similarity 0.75 a chunk of 6 has at most one error with probability
0.53, so all 16 chunks miss a pair with probability 5e-6, at 0.8 with 4e-8.

Links. Documents with one set are one class and are compared once. First, classes that
agree in a whole chunk meet the smallest class of that bucket (as many rows as the bucket
has), and confirmed links join them to components, so that a group of a thousand near
copies is mostly one component. Then only buckets that still hold several components
compare their classes. That work is quadratic in the classes of such a bucket, its rows
are not: a bucket is dealt into slices of about ``SLICE`` classes, each pair of slices is a
block, and the task that holds a block compares its signatures in numpy. It gives out a pair
only in the first bucket that the two classes share, and only if it may be a link:

* sizes that allow it,
* signatures that differ in at most ``FAR`` places (similarity 0.75 exceeds it with probability 4e-8),
* sketches that allow it. A sketch has four bits for each of ``BINS`` ranges of shingle hashes: a
  print of the smallest one, 0 if there is none. Of the ranges that either set reaches, those with
  one smallest hash are a draw without replacement from the union, so their number at similarity 0.75
  has a known spread, much smaller than that of the signature; ``SPREADS`` of them are allowed.

Such pairs are confirmed on full sets. Links inside one component are not all listed:
component_id does not depend on them.

Defined cases: null, empty and white-space texts have no shingles, link with nothing and
are kept; fewer than five words are one shingle of the whole sequence; documents with one
text always link; equal doc_ids with different texts are different documents; a class is
named by a 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.arrow_text import MIX, mix, signed, slices, split_words, string_hashes, window_hashes, window_starts
from webloom.llm.components import connected_components
from webloom.llm.stages import Stages
from webloom.session import broadcast_if_small

WIDTH = 5
HASHES = 96
BITS = 16
CHUNKS = 16
MAX_DISTANCE = 31
#: Places that may differ in a candidate that is confirmed on full sets.
FAR = 48
#: Ranges of shingle hashes, told by a hash's first ten bits.
BINS = 1024
#: Standard deviations (and two bins) below its mean that a sketch of a link may lie.
SPREADS = 5.5
#: Classes of one slice of a bucket, about; a block has two slices at most.
SLICE = 2048
#: Pairs that a task compares at a time.
PAIRS = 1 << 16
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingle hashes of each text, sorted."""
    words = split_words(texts, lower=True)
    total = len(words.codes)
    counts = words.counts
    hashes = string_hashes(words.dictionary)[words.codes]
    runs = window_hashes(hashes, width)
    starts = np.flatnonzero(window_starts(words.offsets, width, total)[: len(runs)])
    owner = words.owners()
    keys, owners = [runs[starts]], [owner[starts]]
    for n in range(1, width):
        docs = np.flatnonzero(counts == n)
        if len(docs):
            at = words.offsets[docs]
            keys.append(np.array([window_hashes(hashes[a : a + n], n, seed=n)[0] for a in at], np.uint64))
            owners.append(docs)
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    return key, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(counts)))))


def set_names(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit name per set; sets are sorted, so equal sets get equal names."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys + MIX), dtype=np.uint64)))
    twice = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(mix(keys) ^ MIX), dtype=np.uint64)))
    size = np.diff(offsets).astype(np.uint64)
    one = sums[offsets[1:]] - sums[offsets[:-1]]
    two = twice[offsets[1:]] - twice[offsets[:-1]]
    return mix(mix(one + size) ^ two)


@cache
def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(20240501)
    odd = draw.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, draw.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


def signatures(keys: np.ndarray, offsets: np.ndarray, n: int = HASHES) -> np.ndarray:
    """(documents, n) b-bit minima as uint16; rows of empty sets are zero."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), n), np.uint16)
    if not len(full):
        return out
    starts = offsets[full]
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    odd, add = hash_family(n)
    for i in range(n):
        x = (low ^ add[i]) * odd[i]
        x ^= x >> np.uint32(15)
        x += high * odd[n - 1 - i]
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(x, starts)
        least ^= least >> np.uint32(16)
        least *= np.uint32(0x7FEB352D)
        out[full, i] = (least >> np.uint32(16)).astype(np.uint16)
    return out


def sketches(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, BINS / 2) bytes, two ranges in each: a print of a range's smallest hash, 0 where a set has none."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes) * BINS, np.uint8)
    at = np.repeat(np.arange(len(sizes)) * BINS, sizes) + (keys >> np.uint64(54)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out[at[first]] = keys[first] % np.uint64(15) + np.uint64(1)
    return out[::2].reshape(len(sizes), -1) | out[1::2].reshape(len(sizes), -1) << np.uint8(4)


def allowed_errors(chunks: int, distance: int) -> list[int]:
    """Errors allowed in each chunk so that no pair within ``distance`` is missed."""
    r, e = divmod(distance, chunks)
    return [r if c <= e else r - 1 for c in range(chunks)]


def bucket_keys(sigs: np.ndarray, chunks: list[int], distance: int = MAX_DISTANCE, n_chunks: int = CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, chunk of each key): all bucket keys of every signature over the given chunks."""
    width = sigs.shape[1] // n_chunks
    keys, of = [], []
    for chunk, errors in zip(chunks, allowed_errors(len(chunks), distance), strict=True):
        if errors < 0:
            continue
        part = sigs[:, chunk * width : (chunk + 1) * width].astype(np.uint64)
        for left in combinations(range(width), max(width - errors, 0)):
            key = np.full(len(sigs), (chunk * 256 + sum(1 << p for p in left)) * int(MIX1) % 2**64, np.uint64)
            for p in left:
                key = mix(key * MIX + part[:, p])
            keys.append(key)
            of.append(chunk)
    return np.stack(keys, 1), np.array(of)


MIX1 = np.uint64(0xD6E8FEB86659FD93)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        keys, offsets = shingle_sets(part.column("text"))
        sizes = np.diff(offsets)
        binary = lambda rows: pa.array([r.tobytes() if n else None for r, n in zip(rows, sizes.tolist(), strict=True)], pa.binary())  # noqa: B023, E731
        yield pa.RecordBatch.from_pydict({
            "doc_id": part.column("doc_id"),
            "n_shingles": pa.array(sizes, pa.int64()),
            "class": pa.array(signed(set_names(keys, offsets))),
            "sig": binary(signatures(keys, offsets)),
            "sketch": binary(sketches(keys, offsets)),
        })


def table_of(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as the rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


#: The lowest bits of a key are its number among the keys of a signature.
NUMBER = 127


def _index(distance: int):
    """Rows (own, key) of every signature, ``own`` being the column beside it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys, _ = bucket_keys(table_of(part.column("sig"), np.uint16), list(range(CHUNKS)), distance)
                m = keys.shape[1]
                keys = np.ascontiguousarray(keys & ~np.uint64(NUMBER) | np.arange(m, dtype=np.uint64))
                own = np.repeat(part.column("own").to_numpy(), m)
                yield pa.RecordBatch.from_pydict({"own": pa.array(own), "key": pa.array(signed(keys.reshape(-1)))})

    return task


def first_shared(wrong: np.ndarray) -> np.ndarray:
    """The number of the first key within ``MAX_DISTANCE`` that two signatures share; ``wrong``
    (pairs, HASHES) is true where they differ. Each chunk has one allowed error."""
    parts = wrong.reshape(len(wrong), CHUNKS, HASHES // CHUNKS)
    errors = parts.sum(2, dtype=np.int8)[:, :, None] - parts
    return (errors[:, :, ::-1] == 0).reshape(len(wrong), HASHES).argmax(1)  # the first key of a chunk leaves its last place out


def may_link(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets with these sketches and sizes may be similar enough."""
    share = PERCENT / 100
    seen = same = 0
    for half in (15, 240):
        a, b = sa & np.uint8(half), sb & np.uint8(half)
        seen = seen + ((a | b) > 0).sum(1)
        same = same + ((a == b) & (a > 0)).sum(1)
    drawn = np.clip(1 - seen * (1 + share) / (na + nb), 0, 1)
    return same >= share * seen - SPREADS * np.sqrt(share * (1 - share) * seen * drawn) - 2


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            one, two = (table_of(part.column(c), np.uint16) for c in ("sig_a", "sig_b"))
            sketch = (table_of(part.column(c), np.uint8) for c in ("sketch_a", "sketch_b"))
            ok = ((one != two).sum(1) <= FAR) & may_link(*sketch, part.column("na").to_numpy(), part.column("nb").to_numpy())
            yield part.filter(pa.array(ok)).select(["a", "b", "na", "nb"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible links (a, b, na, nb) of rows sorted by block; a block may span batches."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        if rows.num_rows:
            last = int(block_starts(rows)[-1])
            yield from pairs_of(rows.slice(0, last))
            rest = rows.slice(last)
    if rest is not None:
        yield from pairs_of(rest)


def block_starts(rows: pa.RecordBatch) -> np.ndarray:
    """For every row the place where its block starts."""
    fresh = np.ones(rows.num_rows, bool)
    fresh[1:] = False
    for c in ("key", "low", "high"):
        x = rows.column(c).to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


def pairs_of(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Possible links of whole blocks, a few pairs at a time."""
    if rows.num_rows < 2:
        return
    starts = block_starts(rows)
    before = np.arange(rows.num_rows) - starts
    sigs, sketch = table_of(rows.column("sig"), np.uint16), table_of(rows.column("sketch"), np.uint8)
    names, comps, n, own, key, low, high = (rows.column(c).to_numpy() for c in ("class", "comp", "n", "slice", "key", "low", "high"))
    number = key & NUMBER
    ends = np.cumsum(before)
    at = 0
    while at < rows.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        width = before[at:stop]
        q = np.repeat(np.arange(at, stop), width)
        p = starts[q] + np.arange(len(q)) - np.repeat(np.cumsum(width) - width, width)
        at = stop
        keep = (comps[p] != comps[q]) & ((low[q] == high[q]) | (own[p] != own[q]))
        keep &= 100 * np.minimum(n[p], n[q]) >= PERCENT * np.maximum(n[p], n[q])
        p, q = p[keep], q[keep]
        wrong = sigs[p] != sigs[q]
        near = wrong.sum(1) <= FAR
        near[near] = first_shared(wrong[near]) == number[q[near]]
        p, q = p[near], q[near]
        good = may_link(sketch[p], sketch[q], n[p], n[q])
        p, q = p[good], q[good]
        if len(p):
            yield pa.RecordBatch.from_pydict({"a": pa.array(names[p]), "b": pa.array(names[q]), "na": pa.array(n[p]), "nb": pa.array(n[q])})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        keys, offsets = shingle_sets(part.column("text"))
        yield pa.RecordBatch.from_pydict({
            "class": pa.array(signed(set_names(keys, offsets))),
            "shingles": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(keys))),
        })


SIZES_FIT = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"


PAIR = "a long, b long, na long, nb long"


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, stages: Stages) -> DataFrame:
    """The pairs (a, b, na, nb) of classes whose full sets are similar enough."""
    pairs = stages.write(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = stages.write(classes.select("doc_id", "class").join(wanted, "class", "left_semi"), "wanted")
    texts = docs.select("doc_id", "text").join(broadcast_if_small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "class long, shingles array<long>")
    sets = stages.write(sets.join(broadcast_if_small(wanted.select("class")), "class", "left_semi").dropDuplicates(["class"]), "sets")
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", both.alias("both"))
    out = stages.write(near.where(100 * F.col("both") >= PERCENT * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "links")
    stages.drop(sets)
    stages.drop(pairs)
    return out


def bucket_stars(classes: DataFrame) -> DataFrame:
    """Each class with the smallest class of its whole chunks, if the two may be linked."""
    rows = classes.select(F.col("class").alias("own"), "sig").mapInArrow(_index(CHUNKS - 1), "own long, key long")
    pivot = rows.groupBy("key").agg(F.min("own").alias("a"), F.count("*").alias("size")).where("size > 1")
    stars = rows.join(pivot, "key").where("own <> a").select("a", F.col("own").alias("b")).distinct()
    of = classes.select("class", "n", "sig", "sketch")
    stars = stars.join(of.toDF("a", "na", "sig_a", "sketch_a"), "a").join(of.toDF("b", "nb", "sig_b", "sketch_b"), "b")
    fit = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
    return stars.where(fit).mapInArrow(_possible, PAIR)


def cross_pairs(classes: DataFrame, comps: DataFrame, stages: Stages) -> DataFrame:
    """Possible links between classes of different components (``comps``: class, comp; a class that
    is not there is a component by itself)."""
    tagged = classes.select("class", "n", "sig", "sketch").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    kind = F.hash("comp").alias("own")  # two components of a bucket look like one with probability 2^-32
    rows = tagged.select(kind, "sig").mapInArrow(_index(MAX_DISTANCE), "own int, key long")
    buckets = rows.groupBy("key").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.count("*").alias("size")).where("least <> most")
    buckets = stages.write(buckets.select(F.col("key").alias("bucket"), F.ceil(F.col("size") / SLICE).cast("int").alias("slices")), "mixed")
    rows = classes.select(F.col("class").alias("own"), "sig").mapInArrow(_index(MAX_DISTANCE), "own long, key long")
    live = rows.join(broadcast_if_small(buckets), F.col("key") == F.col("bucket")).select("key", F.col("own").alias("class"), "slices")
    live = stages.write(live, "live")
    live = live.join(tagged, "class").withColumn("slice", F.pmod(F.xxhash64("class"), F.col("slices").cast("long")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    block = [F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high")]
    live = live.select("key", *block, "slice", "class", "comp", "n", "sig", "sketch").repartition("key", "low", "high")
    return live.sortWithinPartitions("key", "low", "high").mapInArrow(_meet, PAIR)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, class, component_id, kept."""
    spark = docs.sparkSession
    stages = Stages(spark, "minhash")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed_docs = stages.write(
        docs.select("doc_id", "text").mapInArrow(_sign, f"doc_id {kind}, n_shingles long, class long, sig binary, sketch binary"), "signed")
    full = signed_docs.where("sig is not null")
    first = [F.first(c).alias(c) for c in ("sig", "sketch")]
    classes = stages.write(full.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), *first), "classes")
    links = confirmed(bucket_stars(classes), docs, classes, stages)
    roots = connected_components(links, stages)

    more_links = confirmed(cross_pairs(classes, roots.toDF("class", "comp"), stages), docs, classes, stages)
    if not more_links.isEmpty():
        roots = connected_components(links.unionAll(more_links), stages)

    members = classes.select("class", F.col("doc_id").alias("first")).join(roots.toDF("class", "root"), "class", "left")
    members = members.select("class", "first", F.coalesce("root", "class").alias("root"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(least, "root").select("class", "component_id")
    out = signed_docs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class")).join(named, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", "class", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
