"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms, each 32 bits: lower-cased words, the first
four and six characters of longer ones, and such beginnings again where two, or
three and more, different words share them. The machine scores

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

over the terms it knows, so a pair (an insult beside a group's name) can count
for more or less than its two terms do. It knows the ``terms`` hashed terms with
the largest chi-square against the label, learned on a bounded sample of labelled
rows (``fit_rows``, half from each class, chosen by a hash of the id). Terms are counted
where the rows are; only the best and the places of the rows' own reach the driver. A seventh of the sample is kept out of
the fit and sets the intercept: 0.5 is where the fewest of these rows fall on the
wrong side. Scoring is one map over the documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches, written

_WORD = re.compile(r"\w+")
PREFIXES = (4, 6)
#: Terms that a machine knows, and labelled rows that have one of them at least.
TERMS, LEAST_DOCS = 4096, 3


def term_hashes(text: str) -> np.ndarray:
    """Sorted distinct hashed terms of a text."""
    words = set(_WORD.findall(text.lower()))
    terms = {zlib.crc32(w.encode()) for w in words}
    for n in PREFIXES:
        for p, times in Counter([w[:n] for w in words if len(w) > n]).items():
            terms.add(stem := zlib.crc32(p.encode(), 7))
            if times > 1:
                terms.add(stem ^ (0x5BD1E995 if times == 2 else 0x1B873593))
    return np.sort(np.fromiter(terms, np.uint32, len(terms)))


def _places(terms: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places in keys of the terms that are there; both sorted, without repeats."""
    return np.searchsorted(keys, np.intersect1d(terms, keys, assume_unique=True))


@dataclass
class FactorizationMachine:
    keys: np.ndarray  # sorted hashed terms
    w0: float
    w: np.ndarray
    v: np.ndarray

    def known(self, terms: np.ndarray) -> np.ndarray:
        """Positions in keys of the terms that are there."""
        return _places(terms, self.keys)

    def logit(self, terms: np.ndarray) -> float:
        return self.value(self.known(terms))

    def value(self, at: np.ndarray) -> float:
        v = self.v[at]
        return float(self.w0 + self.w[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))


def _chi_square(docs: list[np.ndarray], y: np.ndarray, terms: int) -> np.ndarray:
    """The terms that tell the classes apart best, as best_terms() has them, of texts in memory."""
    keys, df = np.unique(np.concatenate(docs), return_counts=True) if docs else (np.zeros(0, np.uint32), np.zeros(0, int))
    pos = np.zeros(len(keys))
    for d, label in zip(docs, y, strict=True):
        if label:
            pos[np.searchsorted(keys, d)] += 1
    n, p = len(y), y.sum()
    expected = df * p / max(n, 1)
    var = expected * (1 - p / max(n, 1)) * (1 - df / max(n, 1))
    chi = np.where(df >= LEAST_DOCS, (pos - expected) ** 2 / np.maximum(var, 1e-9), -1)
    best = np.lexsort((keys, -chi))[:terms]
    return np.sort(keys[best[chi[best] > 0]])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = np.array(batch.column("y").to_pylist(), np.int64)
        docs = [np.frombuffer(t, "<u4") for t in batch.column("terms").to_pylist()]
        keys, at = np.unique(np.concatenate(docs), return_inverse=True)
        label = np.repeat(y, [len(d) for d in docs])
        yield pa.RecordBatch.from_pydict({"term": keys.astype(np.int64), "df": np.bincount(at, minlength=len(keys)), "pos": np.bincount(at, label, len(keys)).astype(np.int64)})


def best_terms(rows: DataFrame, terms: int) -> np.ndarray:
    """Sorted hashed terms with the largest chi-square against y, of those in LEAST_DOCS rows or more.
    rows: y, terms. Counted where the rows are; ``terms`` numbers reach the driver."""
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = max(total.n, 1), total.p
    counts = rows.mapInArrow(_count_rows, "term long, df long, pos long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos")).where(F.col("df") >= LEAST_DOCS)
    expected = F.col("df") * F.lit(p / n)
    var = expected * F.lit(1 - p / n) * (1 - F.col("df") / F.lit(float(n)))
    chi = counts.withColumn("chi", (F.col("pos") - expected) ** 2 / F.greatest(var, F.lit(1e-9)))
    return np.sort(np.array([r.term for r in chi.where("chi > 0").orderBy(F.desc("chi"), "term").limit(terms).collect()], np.uint32))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the values that leave the fewest rows on the wrong side; 0 if a class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))  # cut before row i
    best = np.flatnonzero(wrong[1:-1] == wrong[1:-1].min()) + 1
    middle = best[len(best) // 2] if len(best) > 1 else best[0]
    return float((z[middle - 1] + z[middle]) / 2)


def fit_machine(docs: list[np.ndarray], y: np.ndarray, terms: int = TERMS, **options) -> FactorizationMachine:
    """A machine for sets of hashed terms in memory; every seventh row only sets the intercept."""
    out = np.arange(len(y)) % 7 == 3
    keys = _chi_square([d for d, x in zip(docs, out, strict=True) if not x], y[~out], terms)
    return train(keys, [_places(d, keys) for d in docs], y, out, **options)


def train(keys: np.ndarray, rows: list[np.ndarray], y: np.ndarray, out: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the logistic loss. rows: places in keys of each row's terms; the rows in out only set
    the intercept."""
    test, test_y = [r for r, x in zip(rows, out, strict=True) if x], y[out]
    rows, y = [r for r, x in zip(rows, out, strict=True) if not x], y[~out]
    m = FactorizationMachine(keys, 0.0, np.zeros(len(keys)), np.random.default_rng(seed).normal(0, 0.02, (len(keys), rank)))
    if not len(keys) or not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        m.w0 = float(np.log(share / (1 - share)))
        return m
    g0, gw, gv = 1e-8, np.full(len(keys), 1e-8), np.full((len(keys), rank), 1e-8)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 128)):
            at = np.concatenate([rows[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            v = m.v[at]
            sums = np.stack([np.bincount(row, v[:, f], len(batch)) for f in range(rank)], axis=1)
            squares = np.bincount(row, (v**2).sum(axis=1), len(batch))
            z = m.w0 + np.bincount(row, m.w[at], len(batch)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            touched, slot = np.unique(at, return_inverse=True)
            dw = np.bincount(slot, err[row], len(touched)) + decay * m.w[touched]
            dv_rows = err[row][:, None] * (sums[row] - v)
            dv = np.stack([np.bincount(slot, dv_rows[:, f], len(touched)) for f in range(rank)], axis=1) + decay * m.v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            g0 += err.sum() ** 2
            m.w[touched] -= rate * dw / np.sqrt(gw[touched])
            m.v[touched] -= 0.3 * rate * dv / np.sqrt(gv[touched])
            m.w0 -= rate * err.sum() / np.sqrt(g0)
    m.w0 -= _best_cut(np.array([m.value(r) for r in test]), test_y)
    return m


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [term_hashes(x or "").astype("<u4").tobytes() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "kept_out": batch.column("kept_out"), "terms": pa.array(terms, pa.binary())})


def _known_rows(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [_places(np.frombuffer(t, "<u4"), keys).astype("<u4").tobytes() for t in batch.column("terms").to_pylist()]
        yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "kept_out": batch.column("kept_out"), "at": pa.array(at, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 12000, terms: int = TERMS, **options) -> FactorizationMachine:
    """labels: doc_id, toxic. Rows with a null label or id are not learned from; an id that is
    labelled twice counts as toxic if one of its labels is, and rows of one id are all learned from.
    A null text is an empty one. fit_rows bounds the labelled ids. What reaches the driver is the
    best terms and, of each row, which of them it has, however long its text is. With no
    labelled rows, or one class only, every text gets the smoothed share of the class."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    half = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2) for c in (0, 1)]
    sample = F.broadcast(half[0].unionByName(half[1]))  # fit_rows rows at most
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sampled = text.join(sample, "doc_id").select("y", (F.pmod(F.xxhash64("doc_id"), F.lit(7)) == 3).alias("kept_out"), "text")
    rows = written(sampled.mapInArrow(_term_rows, "y int, kept_out boolean, terms binary"), "terms")
    with batches(docs.sparkSession):
        keys = best_terms(rows.where("NOT kept_out"), terms)
        got = rows.mapInArrow(lambda b: _known_rows(b, keys), "y int, kept_out boolean, at binary").collect()
    got = sorted((r.y, r.kept_out, bytes(r.at)) for r in got)
    return train(keys, [np.frombuffer(a, "<u4").astype(np.int64) for *_, a in got], np.array([y for y, *_ in got], np.float64), np.array([x for _, x, _ in got], bool), **options)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier), predicted (1 from 0.5 on).

    A null text counts as empty, and an empty one gets the model's intercept, as does a text
    with no known term. One row per input row, whole texts, no other column read; null ids
    and repeated rows come back as they are, equal texts get equal scores; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def rows(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in given:
            z = np.array([m.logit(term_hashes(x or "")) for x in batch.column("text").to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": p, "predicted": pa.array((p >= 0.5).astype(np.int32))})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(rows, "doc_id long, score double, predicted int"), "toxicity")
