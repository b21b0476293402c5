"""Near-duplicate groups whose buckets hold many classes: held to brute force, and few pairs given out."""

import numpy as np
import pyarrow as pa

from webloom.llm import minhash


def texts(groups=3, copies=60, n=80, edits=(1, 2, 3, 4)):
    """Copies of a text with a few words changed, so that similarities lie around the limit."""
    draw = np.random.RandomState(8)
    out = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(n)]
        for c in range(copies):
            words = list(base)
            for at in draw.choice(n, edits[c % len(edits)], replace=False):
                words[at] = f"x{g}c{c}a{at}"
            out.append(" ".join(words))
    return out


def components(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in rows)]
    root = list(range(len(rows)))
    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                links += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert links and len(set(root)) > len(rows) // 4  # many linked, many not
    return root


def test_groups_equal_brute_force_in_slices(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE", 16)  # the groups' buckets are dealt into several blocks
    rows = texts()
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(got)] == components(rows)


def block(rows):
    keys, offsets = minhash.shingle_sets(pa.array(rows))
    sigs, sketch = minhash.signatures(keys, offsets), minhash.sketches(keys, offsets)
    shared, _ = minhash.bucket_keys(sigs, list(range(minhash.CHUNKS)))
    out = []
    for number in range(shared.shape[1]):
        for key in np.unique(shared[:, number]):
            out += [(int(key) & 2**62 - 128 | number, i) for i in np.flatnonzero(shared[:, number] == key).tolist()]
    out.sort()
    key, own = np.array(out).T
    zero = np.zeros(len(own), np.int32)
    return pa.RecordBatch.from_pydict({
        "key": key, "low": zero, "high": zero, "slice": zero, "class": own, "comp": own, "n": np.diff(offsets)[own],
        "sig": [sigs[i].tobytes() for i in own], "sketch": [sketch[i].tobytes() for i in own]})


def test_a_pair_is_given_out_once_and_only_if_it_may_be_a_link():
    rows = texts(groups=1, copies=80, edits=(4, 5))
    batch = block(rows)
    found = [tuple(sorted((r["a"], r["b"]))) for cut in (batch.num_rows, 7) for part in minhash._meet(
        iter(batch.slice(at, cut) for at in range(0, batch.num_rows, cut))) for r in part.to_pylist()]
    assert len(found) == 2 * len(set(found))  # once whatever the batches
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in rows]
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    pairs = {(i, j) for j in range(len(rows)) for i in range(j)}
    assert {p for p in pairs if share(*p) >= 0.75} <= set(found)
    assert len(set(found)) < len(pairs) / 4  # nearly all pairs share buckets, at similarities of 0.3 to 0.7
    assert list(minhash._meet(iter([batch.slice(0, 0)]))) == []


def test_sketches_of_links_pass():
    draw = np.random.RandomState(2)
    for n in (1, 4, 7, 30, 200, 3000):
        for _ in range(30):
            union = draw.randint(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            common = -(-3 * n // 4)
            cut = common + draw.randint(n - common + 1)
            sets = [np.sort(union[:cut]), np.sort(np.r_[union[:common], union[cut:]])]
            one, two = (minhash.sketches(s, np.array([0, len(s)])) for s in sets)
            assert minhash.may_link(one, two, *(np.array([len(s)]) for s in sets)).all()
