"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A fingerprint has 64 bits, the majority of the XXH64 hashes of the text's 3-word
shingles. Two fingerprints that differ in at most 3 bits agree in one of four
16-bit blocks, so the distinct fingerprints are dealt into tiles by (block,
value); a tile that holds many is dealt again by a 12-bit part of what remains
(one of four of those agrees as well), which keeps tiles small at any size
without losing a pair. Inside a tile, sorted by population count, numpy compares
by exclusive-or and bit count, and sub-tile pairs whose population counts differ
by more than the radius are skipped. A tile emits a star for each group it finds,
never all pairs; groups of tiles meet in distributed connected components.

Copies share one fingerprint and cost one row from the first aggregation on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import id_order, join_classes, one_row_each, parallelism, written
from quire.llm.components import components

RADIUS = 3
SHINGLE = 3
#: Fingerprints in a tile from which on it is dealt again, and side of a sub-tile.
TILE, SIDE = 4096, 2048
#: Fingerprints of one tile from which on its task deals them again by a quarter of the bits that differ.
SPLIT = 16_384
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a text: A-Z lowered, shingles of 3 words, all words if there are fewer; 0 for none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    slices = zip(starts[: n - 2].tolist(), ends[2:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in slices), np.uint64, n - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        part = h[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = np.array([fingerprint(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())], np.uint64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "f": f.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), f (the fingerprint's bits as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_rows, "doc_id long, th long, f long")


class _Groups:
    """Union of positions, by smallest position."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.parent[self.parent] != self.parent).any():
                self.parent[up] = self.parent[self.parent[up]]


def tile_groups(tile: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links among fingerprints within RADIUS of each other in the same tile.

    tile and f are sorted by tile, then population count. Returns (fingerprint,
    the first of its group) for each one that isn't the first.
    """
    groups = _Groups(len(f))
    _compare(tile, f, np.arange(len(f)), groups)
    other = np.flatnonzero(groups.parent != np.arange(len(f)))
    return f[other], f[groups.parent[other]]


def _compare(tile: np.ndarray, f: np.ndarray, place: np.ndarray, groups: _Groups) -> None:
    """Link the places of near fingerprints of one tile; all sorted by tile, then population count."""
    n = len(f)
    pop = np.bitwise_count(f).astype(np.int16)
    cuts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
    starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [n])))
    small = sizes <= 128
    ends = np.repeat(starts + sizes, sizes)  # of the tile of each position
    at = np.flatnonzero(np.repeat(small, sizes))
    step = 1
    while len(at):  # all small tiles at once: each against the step-th after it
        at = at[at + step < ends[at]]
        at = at[pop[at + step] - pop[at] <= RADIUS]
        near = np.bitwise_count(f[at] ^ f[at + step]) <= RADIUS
        groups.link(place[at[near]], place[at[near] + step])
        step += 1
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        if size > SPLIT:
            # of four parts of the bits that differ at all, one agrees in fingerprints within 3 bits
            own, where = f[start : start + size], place[start : start + size]
            differ = int(np.bitwise_or.reduce(own ^ own[0]))
            bits = [k for k in range(64) if differ >> k & 1]
            for part in range(RADIUS + 1):
                key = own & np.uint64(sum(1 << k for k in bits[part :: RADIUS + 1]))
                order = np.lexsort((own, np.bitwise_count(own), key))
                _compare(key[order], own[order], where[order], groups)
            continue
        for a in range(start, start + size, SIDE):
            a_end = min(a + SIDE, start + size)
            for b in range(a, start + size, SIDE):
                if pop[b] - pop[a_end - 1] > RADIUS:
                    break
                b_end = min(b + SIDE, start + size)
                for lo in range(a, a_end, 256):
                    x, y = np.nonzero(np.bitwise_count(f[lo : min(lo + 256, a_end), None] ^ f[None, b:b_end]) <= RADIUS)
                    groups.link(place[x + lo], place[y + b])


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles, prints, held, wanted = [], [], 0, 50_000

    def out(tile: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = tile_groups(tile, f)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_pydict({"hi": np.maximum(a, b), "lo": np.minimum(a, b)})

    for batch in batches:  # sorted by tile: the last tile of a batch may go on in the next
        tiles.append(batch.column("tile").to_numpy())
        prints.append(batch.column("f").to_numpy().view(np.uint64))
        held += batch.num_rows
        if held >= wanted:
            tile, f = np.concatenate(tiles), np.concatenate(prints)
            cut = int(np.searchsorted(tile, tile[-1]))
            if cut:
                yield out(tile[:cut], f[:cut])
            tiles, prints, held = [tile[cut:]], [f[cut:]], held - cut
            wanted = max(50_000, 2 * held)
    if held:
        yield out(np.concatenate(tiles), np.concatenate(prints))


def links(distinct: DataFrame) -> DataFrame:
    """hi, lo: links that connect just what a chain of steps of RADIUS bits connects.

    distinct: one column f, each fingerprint once.
    """
    spark = distinct.sparkSession
    dealt = distinct.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("value", F.expr("shiftrightunsigned(f, CAST(block AS INT) * 16) & 65535"))
    full = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("block", "value", F.lit(True).alias("again"))
    dealt = dealt.join(F.broadcast(full), ["block", "value"], "left")  # at most 4 x 65536 rows
    # what remains: the 48 bits of the other blocks, in their order
    rest = F.expr(
        "CASE block WHEN 0 THEN shiftrightunsigned(f, 16)"
        " WHEN 1 THEN (f & 65535) | shiftleft(shiftrightunsigned(f, 32), 16)"
        " WHEN 2 THEN (f & 4294967295) | shiftleft(shiftrightunsigned(f, 48), 32)"
        " ELSE f & 281474976710655 END"
    )
    parts = F.when(F.col("again"), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(-1)))
    tiles = dealt.withColumn("rest", rest).withColumn("part", F.explode(parts)).select(
        F.expr(
            "block * 65536 + value"
            " + CASE WHEN part < 0 THEN 0L ELSE (1L + part * 4096L + (shiftrightunsigned(rest, CAST(greatest(part, 0) * 12 AS INT)) & 4095)) * 262144L END"
        ).alias("tile"),
        "f",
    )
    sorted_tiles = tiles.repartition(parallelism(spark), "tile").sortWithinPartitions("tile", F.bit_count("f"), "f")
    return sorted_tiles.mapInArrow(_tile_rows, "hi long, lo long").distinct()


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, th, f, component_id (the largest long: no row has an id)."""
    prints = written(fingerprints(docs), "fingerprints")
    first = written(prints.groupBy("f").agg(F.min(id_order()).alias("first"), F.count("*").alias("n")), "classes")
    roots = components(links(first.select("f")))
    linked = first.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    total = first.agg(F.sum("n")).first()[0] or 0
    return join_classes(prints, linked.join(least, "root").select("f", "component_id", "n"), "f", total)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links of at most 3 differing bits reach,
    the row's own included. Null and empty texts have fingerprint zero and link like
    any other. A null doc_id is the largest id: it is a component_id (null) only where
    no other row is reachable. Repeated rows give repeated rows; an empty table gives
    an empty one; long texts are read whole; other columns are not carried.
    """
    out = _classes(docs)
    component = F.when(F.col("component_id") == F.lit(2**63 - 1), F.lit(None)).otherwise(F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, but one row of each component: the one with the
    smallest id (then text hash). Texts without a word, null ones too, are one component; null
    ids come last; of repeated rows one stays; an empty table gives an empty one; columns may
    have any names, as whole rows are carried."""
    found = _classes(docs).groupBy("component_id").agg(F.min(F.struct(id_order().alias("o"), F.col("th").alias("h"))).alias("first"))
    return one_row_each(docs, found.select("first.o", "first.h")).select("row.*")
