"""Language identification as inference of a mixture of languages.

Learning: for every labelled language the letter trigrams (lower case, words bounded by
spaces) of all its training texts are counted in ``BUCKETS`` hash buckets. Counts are summed
in Spark; the model is one row per language and bucket, so its size does not grow with the
corpus.

Inference: a document is a mixture of languages. Expectation-maximisation estimates the
proportions from the trigram likelihoods. The set of languages is chosen by penalised
likelihood: starting with all of them (many at once while more than ``START`` are left), the
language with the least share leaves as long as the likelihood less ``PENALTY * log(trigrams)`` per language grows. The
prediction is the language with the largest share, the score its share.

Defined cases: a null text, one without letters, or a model without languages: ``und``, score
0; equal shares: the first name; a null language or text teaches nothing; repeated rows count
each time; long texts are counted in pieces; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.arrow_text import slices

BUCKETS = 1 << 16
SMOOTH = 0.3
START = 8
PENALTY = 3.0
ROUNDS = 12
#: Languages a model may hold; their rows reach every task.
MAX_LANGUAGES = 1000
PIECE = 1 << 20


@cache
def letters() -> np.ndarray:
    """True for the code points of letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's letter trigrams."""
    if len(text) > PIECE:
        total = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(text), PIECE):
            b, n = trigrams(text[at : at + PIECE])
            total[b] += n
        full = np.flatnonzero(total)
        return full, total[full]
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()[codes]
    codes = np.where(known, codes, 32).astype(np.uint64)
    middle = known[1:-1]
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed >> np.uint64(48))[middle].astype(np.int64), return_counts=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for part in slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            if lang not in totals:
                if len(totals) >= 64:
                    yield from _counted(totals)
                    totals = {}
                totals[lang] = np.zeros(BUCKETS, np.int64)
            b, n = trigrams(text)
            totals[lang][b] += n
    yield from _counted(totals)


def _counted(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, total in totals.items():
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(full), pa.string()), "bucket": pa.array(full.astype(np.int32)), "n": pa.array(total[full])})


def learn(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the (BUCKETS, languages) likelihoods from ``texts`` (lang, text)."""
    some = texts.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    sums = some.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    names = sorted(found["lang"].unique().tolist())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; a model holds {MAX_LANGUAGES}")
    table = np.full((BUCKETS, len(names)), SMOOTH, np.float64)
    place = {n: i for i, n in enumerate(names)}
    table[found["bucket"].to_numpy(np.int64), found["lang"].map(place).to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    return names, (table / table.sum(0)).astype(np.float32)


def expectation(p: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns of ``p``) and the log likelihood of the counts."""
    total = counts.sum()
    for _ in range(rounds):
        mass = p @ share
        share = share * ((counts / mass) @ p) / total
    return share, float(counts @ np.log(p @ share))


def mixture(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of all languages under the set with the best penalised likelihood."""
    out = np.zeros(p.shape[1])
    counts = counts.astype(np.float32)
    alive = np.arange(p.shape[1])
    share, fit = expectation(p[:, alive], counts, np.full(len(alive), 1 / len(alive), np.float32))
    cost = PENALTY * np.log(max(float(counts.sum()), 2.0))
    gone = len(alive) // 2 if len(alive) > START else 1  # many at once while there are many
    while len(alive) > 1:
        fewer = np.sort(np.argsort(share, kind="stable")[gone:])
        again, less = expectation(p[:, alive[fewer]], counts, np.maximum(share[fewer], 1e-3) / np.maximum(share[fewer], 1e-3).sum())
        if less < fit - gone * cost:
            if gone == 1:
                break
            gone //= 2
            continue
        alive, share, fit = alive[fewer], again, less
        gone = min(gone, len(alive) // 2) if len(alive) > START else 1
    out[alive] = share
    return out


def _predict(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for part in slices(batches):
            langs, scores, shares = [], [], []
            for text in part.column("text").to_pylist():
                buckets, counts = trigrams(text or "")
                if not len(buckets) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    shares.append([])
                    continue
                share = mixture(table[buckets], counts)
                best = int(np.argmax(share))
                langs.append(names[best])
                scores.append(float(min(1.0, share[best] / share.sum())))
                shares.append([(names[i], float(share[i])) for i in np.flatnonzero(share)])
            rest = {n: part.column(n) for n in part.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(rest | {
                "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()),
                "mixture": pa.array(shares, pa.map_(pa.string(), pa.float64()))})

    return task


def identify(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score and ``mixture`` (language to share) of every row."""
    model = docs.sparkSession.sparkContext.broadcast((names, table))
    some = docs.select("doc_id", "text")
    kind = some.schema["doc_id"].dataType.simpleString()
    return some.mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>")
