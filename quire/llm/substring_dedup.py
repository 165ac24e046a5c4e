"""Exact substring dedup with prefix-partitioned, depth-bounded suffix trees over words.

A window is 50 consecutive words of one document. A word is removed if it lies in a
window whose word sequence also starts in a document with a smaller id.

1. Every window names a 10-word prefix inside it, the one with the smallest hash
   (its anchor), so equal windows name the same anchor. Only the distinct anchors of
   each document are dealt out and counted: an anchor that a single document holds
   has no deep shared node below it, and is dropped here.
2. Documents that hold a shared anchor emit their suffixes below it: stretches of
   text whose windows all name that anchor. The anchor is the prefix that deals them
   into groups. Prefixes have variable length: while the distinct stretches below one
   hold more than ``batch_words`` words, they are dealt again by a prefix of twice the
   length, up to the whole window, where a group is one truncated suffix.
3. Whole groups are packed into batches of at most ``batch_words`` words. In each the
   suffixes are sorted by repeated doubling of the compared length; neighbours that
   agree in all 50 words are below one internal node of depth 50, a repeat, and the
   node carries the smallest document among its leaves.
4. The repeats go back to the stretches, then to the documents, as ranges of windows.

No rows are capped or sampled, copies are never paired, and a group's size is that of
its distinct texts. Texts are worked through in blocks that overlap by 49 words, so the
words of a long one are never all held at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import id_order, parallelism, written

WINDOW = 50
PREFIX = 10
#: Word positions that are sorted at once, and words of a group from which on its prefix is lengthened.
BATCH_WORDS = 600_000
#: Windows of a stretch: a longer one, as in a text of one repeated word, is cut.
STRETCH_WINDOWS = 512
BLOCK_BYTES = 1 << 21
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about BLOCK_BYTES."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK_BYTES)
        end = gap.start() if gap else len(text)
        if words := text[at:end].split():
            yield words
        at = end


def window_blocks(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of words and the place of their first word; each window lies in just one."""
    words, first = [], 0
    for more in word_blocks(text):
        words = words[max(0, len(words) - WINDOW + 1) :] + more
        yield first, words
        first += max(0, len(words) - WINDOW + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_anchors(words: list[bytes], prefix: int = PREFIX) -> np.ndarray:
    """Of each 50-word window, the smallest hash of the sequences of ``prefix`` words in it; as signed."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    grams = np.zeros(n - prefix + 1, np.uint64)
    for j in range(prefix):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : n - prefix + 1 + j]
    low, span, wanted = _mix(grams), 1, WINDOW - prefix + 1
    while span < wanted:
        step = min(span, wanted - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return low.view(np.int64)


class _Digest:
    """SHA-256 of words joined by one blank, fed in parts."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, words: list[bytes]) -> None:
        if words:
            self.sha.update(b" " * self.any + b" ".join(words))
            self.any = True

    def hex(self) -> str:
        return self.sha.hexdigest()


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchors, n_words, sha = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            text = text.as_py() or b""
            digest, n, found = _Digest(), 0, [np.zeros(0, np.int64)]
            for first, words in window_blocks(text):
                found.append(np.unique(window_anchors(words)))
                digest.add(words[n - first :])
                n = first + len(words)
            anchors.append(np.unique(np.concatenate(found)))
            n_words.append(n)
            sha.append(digest.hex())
        cuts = np.concatenate(([0], np.cumsum([len(a) for a in anchors]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(anchors) if anchors else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ord"), batch.column("th"), lists, pa.array(n_words, pa.int64()), pa.array(sha)], names=["doc_id", "ord", "th", "anchors", "n_words", "sha"])


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(1)
    for batch in batches:
        blobs = [squeeze.compress(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("th"), pa.array(blobs, pa.binary())], names=["ord", "th", "blob"])


STRETCH = "anchor long, ctx binary, h binary, words int, ord long, th long, start long"
_STRETCH = pa.schema([("anchor", pa.int64()), ("ctx", pa.binary()), ("h", pa.binary()), ("words", pa.int32()), ("ord", pa.int64()), ("th", pa.int64()), ("start", pa.int64())])


class _Stretches:
    """Collects stretches; full() gives a batch of them from 4000 rows or BLOCK_BYTES on."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, words: list[bytes], anchors: np.ndarray, wanted: np.ndarray | None, ord_: int, th: int, first: int) -> None:
        """The stretches of words whose windows name one anchor, of those in wanted (None: all)."""
        edges = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]))
        shared = np.ones(len(anchors), bool) if wanted is None else np.isin(anchors, wanted)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b or not shared[a]:
                continue
            for at in range(a, b, STRETCH_WINDOWS):
                end = min(at + STRETCH_WINDOWS, b) + WINDOW - 1
                ctx = b" ".join(words[at:end])
                self.rows.append((int(anchors[a]), ctx, hashlib.md5(ctx).digest(), end - at, ord_, th, first + at))
                self.size += len(ctx)

    def full(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or len(self.rows) > 4000 or self.size > BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _STRETCH, strict=True)], schema=_STRETCH)
            self.rows, self.size = [], 0


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Stretches()
    for batch in batches:
        for row in batch.to_pylist():
            wanted = np.array(row["anchors"], np.int64)
            for first, words in window_blocks(zstandard.decompress(row["blob"])):
                out.add(words, window_anchors(words), wanted, row["ord"], row["th"], first)
                yield from out.full()
    yield from out.full(last=True)


def _lengthened_rows(batches: Iterator[pa.RecordBatch], prefix: int) -> Iterator[pa.RecordBatch]:
    """The same windows, in stretches that a longer prefix deals."""
    out = _Stretches()
    for batch in batches:
        for ctx, ord_, th, start in zip(*(batch.column(c).to_pylist() for c in ("ctx", "ord", "th", "start")), strict=True):
            words = ctx.split(b" ")
            out.add(words, window_anchors(words, prefix), None, ord_, th, start)
            yield from out.full()
    yield from out.full(last=True)


def deep_nodes(stretches: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """Of each stretch, by window: the smallest ``least`` among the stretches that hold that window."""
    index: dict[bytes, int] = {}
    codes, sizes = [], []
    for ctx in stretches:
        words = ctx.split(b" ")
        for w in words:
            if w not in index:
                index[w] = len(index) + 1
        codes.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
    sizes_ = np.array(sizes)
    flat = np.concatenate(codes)
    ends = np.cumsum(sizes_)
    left = np.repeat(ends, sizes_) - np.arange(len(flat))  # words up to the stretch's end
    # rank of the suffix at each position by its first `depth` words; shorter ones take no part
    rank, depth = flat, 1
    at = np.arange(len(flat))
    while depth < WINDOW:
        step = min(depth, WINDOW - depth)
        at = at[left[at] >= depth + step]
        key = rank[at] * (int(rank.max()) + 1) + rank[at + step]
        _, inverse = np.unique(key, return_inverse=True)
        rank = np.zeros(len(flat), np.int64)
        rank[at] = inverse + 1
        depth += step
    owner = np.repeat(least, sizes_)[at]
    node = rank[at]
    node_least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(node_least, node, owner)
    return np.split(node_least[node], np.cumsum(sizes_ - WINDOW + 1)[:-1])


REPEATS = "anchor long, h binary, ranges array<struct<lo:int, hi:int, least:long>>"
_REPEATS = pa.schema([("anchor", pa.int64()), ("h", pa.binary()), ("ranges", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("least", pa.int64())])))])


def _repeat_rows(rows: list[tuple]) -> pa.RecordBatch:
    """rows: anchor, ctx, least, most, of whole groups."""
    least, most = np.array([r[2] for r in rows], np.int64), [r[3] for r in rows]
    out = []
    for (anchor, ctx, _, _), found, last in zip(rows, deep_nodes([r[1] for r in rows], least), most, strict=True):
        if found.min() >= last:
            continue  # no smaller document for any of its holders
        cut = np.flatnonzero(np.diff(found)) + 1
        ranges = [{"lo": int(a), "hi": int(b), "least": int(found[a])} for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(found)], strict=True) if found[a] < last]
        out.append({"anchor": anchor, "h": hashlib.md5(ctx).digest(), "ranges": ranges})
    return pa.RecordBatch.from_pylist(out, schema=_REPEATS)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by anchor, a list for each anchor; without those that need no tree: one stretch in one document."""
    group: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in ("anchor", "ctx", "least", "most")), strict=True):
            if group and r[0] != group[0][0]:
                if len(group) > 1 or group[0][2] < group[0][3]:
                    yield group
                group = []
            group.append(r)
    if len(group) > 1 or group and group[0][2] < group[0][3]:
        yield group


def _tree_rows(batches: Iterator[pa.RecordBatch], batch_words: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for group in _groups(batches):
        words = sum(r[1].count(b" ") + 1 for r in group)
        if rows and size + words > batch_words:
            yield _repeat_rows(rows)
            rows, size = [], 0
        rows += group
        size += words
    if rows:
        yield _repeat_rows(rows)


_CUT = pa.schema([("ord", pa.int64()), ("th", pa.int64()), ("n_removed", pa.int64()), ("kept_sha", pa.string()), ("kept", pa.binary())])


def _cut_rows(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            mark = np.zeros(max(r["hi"] for r in row["ranges"]) + WINDOW, np.int32)
            for r in row["ranges"]:
                mark[r["lo"]] += 1
                mark[r["hi"] - 1 + WINDOW] -= 1
            gone = np.cumsum(mark) > 0
            digest, at, pieces = _Digest(), 0, []
            for words in word_blocks(zstandard.decompress(row["blob"])):
                kept = [w for w, x in zip(words, gone[at : at + len(words)].tolist(), strict=False) if not x] + words[max(0, len(gone) - at) :]
                digest.add(kept)
                at += len(words)
                if keep_text and kept:
                    pieces.append(b" ".join(kept))
            out.append({"ord": row["ord"], "th": row["th"], "n_removed": int(gone.sum()), "kept_sha": digest.hex(), "kept": b" ".join(pieces) if keep_text else None})
        yield pa.RecordBatch.from_pylist(out, schema=_CUT)


def _dealt(stretches: DataFrame, batch_words: int) -> DataFrame:
    """The stretches, dealt by longer prefixes until the distinct ones below each fit batch_words."""
    prefix = PREFIX
    while prefix < WINDOW:
        sizes = stretches.groupBy("anchor", "h").agg(F.max("words").alias("words")).groupBy("anchor").agg(F.sum("words").alias("words"))
        large = written(sizes.where(F.col("words") > batch_words).select("anchor"), "large")
        if large.isEmpty():
            break
        prefix = min(2 * prefix, WINDOW)
        again = stretches.join(large, "anchor", "left_semi").mapInArrow(lambda b, n=prefix: _lengthened_rows(b, n), STRETCH)
        stretches = written(stretches.join(large, "anchor", "left_anti").unionByName(again), "stretches")
    return stretches


def repeated_ranges(docs: DataFrame, batch_words: int = BATCH_WORDS) -> tuple[DataFrame, DataFrame]:
    """(one row per input row: doc_id, ord, th, n_words, sha; and per (ord, th) with repeats:
    ranges of window starts to remove, end exclusive). th tells texts of one id apart."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_order().alias("ord"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    per_doc = written(text.mapInArrow(_anchor_rows, "doc_id long, ord long, th long, anchors array<long>, n_words long, sha string"), "anchors")
    occurrences = per_doc.select("ord", "th", F.explode("anchors").alias("anchor"))
    counted = occurrences.groupBy("anchor").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    shared = counted.where("least < most").select("anchor")
    wanted = occurrences.join(shared, "anchor").groupBy("ord", "th").agg(F.collect_set("anchor").alias("anchors"))
    blobs = text.select("ord", "th", "text").mapInArrow(_zipped, "ord long, th long, blob binary")
    stretches = _dealt(written(blobs.join(wanted, ["ord", "th"]).mapInArrow(_stretch_rows, STRETCH), "stretches"), batch_words)
    distinct = stretches.groupBy("anchor", "ctx").agg(F.min("ord").alias("least"), F.max("ord").alias("most"))
    trees = distinct.repartition(parallelism(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _tree_rows(b, batch_words), REPEATS)
    found = stretches.select("anchor", "h", "ord", "th", "start").join(written(trees, "repeats"), ["anchor", "h"])
    ranges = found.select("ord", "th", F.expr("transform(filter(ranges, r -> r.least < ord), r -> struct(start + r.lo AS lo, start + r.hi AS hi))").alias("ranges")).where(F.size("ranges") > 0)
    return per_doc, ranges.groupBy("ord", "th").agg(F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"))


def remove_repeats(docs: DataFrame, batch_words: int = BATCH_WORDS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text), and with
    keep_text the remaining words, joined by spaces, as ``kept_text`` (null: nothing removed).

    A null text has no words; texts under 50 words lose none; the digest of no words is that
    of the empty string. A null doc_id sorts last. Rows with one doc_id are one document:
    they remove nothing from each other. Repeated rows give repeated rows, an empty table an
    empty one, and other columns are not carried.
    """
    per_doc, ranges = repeated_ranges(docs, batch_words)
    text = docs.select(id_order().alias("ord"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    blobs = text.mapInArrow(_zipped, "ord long, th long, blob binary")
    cut = written(blobs.join(ranges, ["ord", "th"]).mapInArrow(lambda b: _cut_rows(b, keep_text), "ord long, th long, n_removed long, kept_sha string, kept binary"), "cut")
    if not keep_text:
        cut = cut.drop("kept")
    cut = cut.dropDuplicates(["ord", "th"])
    out = per_doc.select("doc_id", "ord", "th", "n_words", "sha").join(cut, ["ord", "th"], "left")
    columns = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256")]
    return out.select(*columns, *[F.col("kept").cast("string").alias("kept_text")] * keep_text)
