"""Exact duplicates by progressive refinement: length, then a prefix's hash, then the whole text's.

Texts are equal when identical after lower-casing A-Z. One scan keeps the length and the hash of the
first characters of every text, 16 bytes a row. Lengths that occur once are done; of the others, prefix
hashes that occur once are done; only the texts that are left are hashed in full, in a second scan, and
only their hashes are shuffled: a text itself never is.

What survives a level is told to the scan as a bitmap of fixed size (MARKS bits, 8 MB), which is
broadcast. A false positive costs a hash that was not needed, never a wrong group; where more keys
survive than the bitmap tells apart, more texts are hashed, with the same rows as a result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import id_order, join_classes, one_row_each, written

#: Bits of a bitmap of surviving keys, whatever the number of keys.
MARKS = 1 << 26
#: Characters of a text that the second level hashes.
PREFIX = 256


def lowered(text: Column) -> Column:
    """text with A-Z lowered and nothing else changed. lower() agrees for ASCII texts and is faster there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _slot(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(MARKS)) + 1


def _marks(rows: DataFrame, key: str) -> DataFrame:
    """Bitmaps (mark, bits) of the values of a long column that two rows or more hold: MARKS bits in all."""
    again = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(_slot(key).alias("slot"))
    return again.groupBy(F.bitmap_bucket_number("slot").alias("mark")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def _marked(rows: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """rows with survives: whether the key's bit is set."""
    at = F.bitmap_bit_position(_slot(key))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(byte, off) & 1") == 1
    joined = rows.withColumn("mark", F.bitmap_bucket_number(_slot(key))).join(F.broadcast(marks), "mark", "left")
    return joined.withColumns({"byte": F.coalesce(byte, F.lit(0)), "off": (at % 8).cast("int")}).withColumn("survives", bit).drop("mark", "bits", "byte", "off")


def exact_duplicates(docs: DataFrame, prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id (largest doc_id among equal texts),
    group_size, kept (of a group exactly one row is), digest (SHA-256 of the lowered text; null where
    length or prefix already tell a text apart, unless digest_all), raw (64-bit hash of the text as it is).

    Null text: as the empty text. Null doc_id: below every other; a group of such rows alone has a null keep_id and
    keeps one of them. Rows equal in id and text: one of them is kept. Long texts are read whole. An
    empty table gives no rows; other columns are not carried.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = F.octet_length("text").cast("long")
    head = F.xxhash64(size, lowered(F.substring("text", 1, prefix)))
    seen = written(narrow.select(size.alias("size"), head.alias("head")), "dedup-levels")
    by_size = written(_marks(seen, "size"), "dedup-sizes")
    by_head = written(_marks(_marked(seen, by_size, "size").where("survives"), "head"), "dedup-heads")

    texts = _marked(narrow.withColumn("head", head), by_head, "head")
    wanted = F.lit(True) if digest_all else F.col("survives")
    row = texts.select("doc_id", "survives", F.monotonically_increasing_id().alias("r"), F.xxhash64("text").alias("raw"), F.when(wanted, F.sha2(lowered(F.col("text")), 256)).alias("digest"))
    rows = written(row, "dedup-rows")
    left = rows.where("survives").drop("survives")
    one = left.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("r", F.coalesce("doc_id", F.lit(-(2**63)))).alias("winner"), F.count("*").alias("n"))
    classes = written(one.withColumn("group_size", F.col("n")), "dedup-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest", "raw"]
    grouped = join_classes(left, classes, "digest", total).withColumn("kept", F.col("r") == F.col("winner")).select(*columns)
    single = rows.where("NOT survives").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return single.select(*columns).unionByName(grouped)


def one_of_each(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The rows of docs, with all their columns, that exact_duplicates() keeps."""
    kept = exact_duplicates(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), prefix).where("kept")
    filled = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = one_row_each(filled, kept.select(id_order().alias("o"), F.col("raw").alias("h")))
    return found.select("row.row.*")


ORACLE = """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
    g AS (SELECT doc_id, x, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size FROM t)
    SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g"""
