"""Language identification by nearest centroid.

A text becomes a vector of hashed character 1- to 3-grams, weighted by TF-IDF and
scaled to unit length. Every language is described by a few centroids (spherical
k-means over its texts), a text gets the language of the centroid with the
largest cosine, and a text further from it than that centroid's radius is flagged
as rejected.

Document frequencies are counted over all learning rows. The centroids are fitted
on a bounded sample (``fit_docs`` rows, shared evenly by the languages, chosen by
a hash of the id). The model has ``BUCKETS`` floats a centroid and is the only
thing sent to the executors; scoring is one map over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quire.llm.common import batches as batch_bounds
from quire.llm.common import written

BUCKETS_LOG2 = 13
BUCKETS = 1 << BUCKETS_LOG2
BLOCK_CHARS = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, bool]:
    """Counts of hashed 1- to 3-grams of the lower-cased letters; whether there is a letter.

    Runs of other characters count as one space, and the text stands between two spaces.
    Long texts are worked through in blocks that overlap by two symbols.
    """
    counts = np.zeros(BUCKETS, np.int64)
    tail, any_letter = np.array([32], np.uint32), False
    for at in range(0, max(len(text), 1), BLOCK_CHARS):
        last = at + BLOCK_CHARS >= len(text)
        a = np.frombuffer(text[at : at + BLOCK_CHARS].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = _letters()[a]
        any_letter |= bool(is_letter.any())
        a = np.concatenate((np.where(is_letter, a, 32), [32] if last else [])).astype(np.uint32)
        seq = np.concatenate((tail, a))
        keep = np.ones(len(seq), bool)
        keep[1:] = (seq[1:] != 32) | (seq[:-1] != 32)
        keep[: len(tail)] = True
        seq = seq[keep]
        old = len(tail)
        one = seq * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + one[2:]
        shift = np.uint32(32 - BUCKETS_LOG2)
        for n, h in ((1, one), (2, two), (3, three)):
            new = h[max(0, old - n + 1) :]  # grams that end in this block
            h = (new ^ (new >> np.uint32(16))) * np.uint32(0x27D4EB2F)
            counts += np.bincount(h >> shift, minlength=BUCKETS)
        tail = seq[-2:]
    return counts, any_letter


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def _df_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in _texts(batch):
            df += gram_counts(text)[0] > 0
            n += 1
    yield pa.RecordBatch.from_pydict({"bucket": np.arange(-1, BUCKETS), "n": np.concatenate(([n], df))})


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in _texts(batch):
            counts, _ = gram_counts(text)
            at = np.flatnonzero(counts)
            rows.append(at.astype("<u2").tobytes() + np.log1p(counts[at]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "vector": pa.array(rows, pa.binary())})


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u2", n), np.frombuffer(blob, "<f4", n, 2 * n)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12, starts: int = 4, least: float = 0.02) -> np.ndarray:
    """Spherical k-means, the best of several k-means++ starts; clusters of less than a share of
    ``least`` of the rows are left out and their rows go to the others."""
    rng, best, most = np.random.default_rng(5), x[:1], -np.inf
    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < min(k, len(x)):
            far = np.maximum(1 - (x @ c.T).max(axis=1), 0)
            if far.sum() < 1e-6:
                break
            c = np.concatenate((c, x[[rng.choice(len(x), p=far / far.sum())]]))
        for _ in range(rounds):
            own = np.bincount((x @ c.T).argmax(axis=1), minlength=len(c))
            c = c[own >= max(1, least * len(x))] if own.max() >= least * len(x) else c
            own = (x @ c.T).argmax(axis=1)
            c = _unit(np.stack([x[own == i].mean(axis=0) for i in range(len(c)) if (own == i).any()]))
        if (total := (x @ c.T).max(axis=1).sum()) > most:
            best, most = c, total
    return best


def _radius(x: np.ndarray, c: np.ndarray, quantile: float, least: int = 20) -> list[float]:
    """Of each centroid: the distance that so large a part of the rows nearest to it stay within; of
    all rows, where it has few."""
    cos = x @ c.T
    own, far = cos.argmax(axis=1), 1 - cos.max(axis=1)
    return [float(np.quantile(far[own == i] if (own == i).sum() >= least else far, quantile)) for i in range(len(c))]


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    radius: np.ndarray  # largest cosine distance that is not rejected, by centroid

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of counts: the nearest centroid and its cosine."""
        cos = _unit(np.log1p(counts).astype(np.float32) * self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        return best, cos[np.arange(len(best)), best]


def fit(train: DataFrame, fit_docs: int = 2400, clusters: int = 4, quantile: float = 0.995) -> LanguageModel:
    """Learn from the text and non-null lang of train. fit_docs bounds the sample the
    centroids are fitted on. A quarter of it is kept out of the clusters and sets the radius
    of each: the distance that a share of ``quantile`` of these texts stay within. Null and empty
    texts, null languages and languages without a letter teach nothing; repeated rows count as
    often as they occur, ties go to the row that sorts first; an empty table learns no language."""
    spark = train.sparkSession
    t = train.select(F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("h")).where("lang IS NOT NULL")
    df = t.select("text").mapInArrow(_df_rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    with batch_bounds(spark):
        got = {r.bucket: r.n for r in df.collect()}  # BUCKETS + 1 rows
    total = got.get(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + got.get(i, 0))) + 1 for i in range(BUCKETS)], np.float32)
    sizes = {r.lang: r.n for r in t.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel(idf, np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    each = max(8, fit_docs // len(sizes))
    share = spark.createDataFrame([(k, min(1.0, (1.3 * each + 30) / n)) for k, n in sizes.items()], "lang string, share double")
    bounded = t.join(F.broadcast(share), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) < F.col("share"))
    ranked = bounded.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))).where(F.col("r") <= each)
    with batch_bounds(spark):
        rows = ranked.select("lang", "text").mapInArrow(_vector_rows, "lang string, vector binary").collect()
    langs, centroids, radius = [], [], []
    for lang in sorted(sizes):
        own = [_unpack(v) for v in sorted(bytes(r.vector) for r in rows if r.lang == lang)]
        x = np.zeros((len(own), BUCKETS), np.float32)
        for i, (at, tf) in enumerate(own):
            x[i, at] = tf * idf[at]
        x = _unit(x[x.any(axis=1)])
        if not len(x):
            continue
        out = (np.arange(len(x)) % 4 == 3) if len(x) >= 8 else np.zeros(len(x), bool)
        c = _clusters(x[~out], clusters)
        langs += [lang] * len(c)
        centroids.append(c)
        radius += _radius(x[out] if out.any() else x, c, quantile)
    return LanguageModel(idf, np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS), np.float32), langs, np.array(radius))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the nearest centroid, 0 to 1), rejected.

    A null, empty or letterless text gets ``und`` and score 0; so does every text when
    the model has learned no language. ``rejected`` marks texts outside the radius of
    their centroid; lang_pred then still names the nearest language. Ties go to the
    language that sorts first. Whole texts are read; repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = _texts(batch)
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for lo in range(0, len(texts), 128):
                counted = [gram_counts(t) for t in texts[lo : lo + 128]]
                if not m.langs:
                    break
                best, cos = m.nearest(np.stack([c for c, _ in counted]))
                for i, (_, letter) in enumerate(counted):
                    if letter:
                        lang[lo + i], score[lo + i] = m.langs[best[i]], min(1.0, max(0.0, float(cos[i])))
                        rejected[lo + i] = 1 - cos[i] > m.radius[best[i]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score, "rejected": rejected})

    out = T.StructType.fromDDL("doc_id long, lang_pred string, score double, rejected boolean")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(rows, out), "languages")
