"""Packing sequences into length buckets with the least padding.

Lengths are words. Texts longer than ``max_len`` are cut into pieces of it, so every
word is packed. Over the histogram of the pieces' lengths (at most ``max_len`` rows,
all that reaches the driver) dynamic programming finds the ``buckets`` boundaries
with the least padding, to the row. Inside a bucket, batches of token_budget // boundary
sequences form in an order given by a hash: ranks come from counts of salted
groups, added up in order, so no bucket is ever sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import let, words_of, written

PER_SALT = 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most ``buckets`` buckets with the least total padding.

    lengths ascend and differ. cost(i, j): padding of lengths i to j - 1 to the last of them.
    The best start moves up with j, so each row is solved by halves, in
    O(buckets * n log n).
    """
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    w = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.int64)))
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    starts = []
    for _ in range(min(buckets, n)):
        now, start = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        now[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + lengths[j - 1] * (c[j] - c[i]) - (w[j] - w[i])
            at = int(i[np.argmin(total)])
            now[j], start[j] = total[at - a], at
            todo += [(lo, j - 1, a, at), (j + 1, hi, at, b)]
        starts.append(start)
        best = now
    out, j = [], n
    for start in reversed(starts):
        if j <= 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(start[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 16_384, max_len: int = 4096) -> DataFrame:
    """One row per piece of every row of docs (doc_id, text) that has a word: doc_id, copy,
    piece, n_pieces, first_word (0-based, in this text), n_words, bucket (its boundary: the padded
    length), padding, batch (numbered inside the bucket), slot (inside the batch), words (of the
    piece, one blank between them). copy numbers the rows of one doc_id, from 0; a null id names no
    document, and copy is a number of its own for each such row.

    A batch holds token_budget // bucket pieces, one at least. A null or empty text makes one
    piece of no words, in bucket 0, whose batches hold token_budget pieces. Order inside a
    bucket follows a hash of id and piece; repeated rows are packed as often as they
    occur. An empty table gives an empty one; other columns are not carried.
    """
    def cut(w):
        last = F.greatest(F.lit(1), F.ceil(F.size(w) / max_len)).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("piece"), F.size(w).cast("long").alias("size"), F.array_join(F.slice(w, i * max_len + 1, max_len), " ").alias("words")))

    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), let(words_of(text), cut).alias("cut"))
    first = F.col("x.piece").cast("long") * max_len
    whole = written(rows.select("row", "doc_id", "th", F.size("cut").alias("n_pieces"), F.explode("cut").alias("x")).select("row", "doc_id", "th", "x.piece", "n_pieces", first.alias("first_word"), F.least(F.col("x.size") - first, F.lit(max_len)).alias("n_words"), "x.words"), "pieces")
    narrow = whole.drop("words")
    copy = (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("th", "row")) - 1).cast("long")
    named = narrow.where("doc_id IS NOT NULL").withColumn("copy", copy)
    pieces = written(named.unionByName(narrow.where("doc_id IS NULL").withColumn("copy", F.col("row"))).drop("th"), "copies")
    rows = pieces.groupBy("n_words").agg(F.count("*").alias("n")).orderBy("n_words").collect()
    lengths, counts = np.array([r.n_words for r in rows if r.n_words], np.int64), np.array([r.n for r in rows if r.n_words], np.int64)
    bounds = ([0] if rows and not rows[0].n_words else []) + boundaries(lengths, counts, buckets)
    bucket = F.lit(0)
    for b in reversed(bounds):
        bucket = F.when(F.col("n_words") <= b, F.lit(b)).otherwise(bucket)
    salts = max(1, -(-sum(r.n for r in rows) // PER_SALT))
    h = F.xxhash64("doc_id", "piece", "copy")
    salted = pieces.withColumn("bucket", bucket.cast("int")).withColumn("salt", F.pmod(h, F.lit(salts)))
    order = Window.partitionBy("bucket", "salt").orderBy(h, "doc_id", "piece", "n_words", "copy")
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("bucket", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = salted.withColumn("r", F.row_number().over(order) - 1).join(offsets, ["bucket", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    per_batch = F.greatest(F.lit(1), F.expr(f"{token_budget} div greatest(bucket, 1)"))
    placed = ranked.join(whole.select("row", "piece", "words"), ["row", "piece"])
    return placed.select(
        "doc_id", "copy", "piece", "n_pieces", "first_word", "n_words", "bucket", (F.col("bucket") - F.col("n_words")).alias("padding"),
        F.floor(F.col("rank") / per_batch).cast("long").alias("batch"), (F.col("rank") % per_batch).cast("int").alias("slot"), "words",
    )
