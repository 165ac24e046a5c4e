"""Shared helpers of the training-data operators.

Conventions used by every operator of this subpackage:

* an operator selects the columns it needs first, so extra columns of the
  input, whatever their names, never clash with its own;
* a null text counts as an empty one and a null ``doc_id`` is legal: it sorts
  after every other id and is treated as the empty string when hashed;
* intermediate results that are read more than once are written as Parquet in
  the folder of ``spark.checkpoint.dir``, so a lost executor costs the tasks
  that ran on it and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.shared import folder

#: Sorts after every real id.
NO_ID = 2**63 - 1
#: A word is a run of characters other than the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch of texts: texts can be long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Bound what an Arrow batch holds while plans run inside; the session's own bounds come back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, label: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write df once in the shared folder and read it from there: cuts the lineage. Python stages
    of its plan get Arrow batches of so many rows at most."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    with batches(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of a short ASCII text: byte by byte, bit by bit."""
    bit = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split({text}, '')]), lambda c, b: {byte}), 4294967295::BIGINT)"


def id_order(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def words_of(text: Column) -> Column:
    """Array of the words of a text, empty for a null one (SQL functions only)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: a column that stands inside a lambda would
    be computed again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: A key that holds more than one in so many rows is hot; so there are fewer hot keys than this.
HOT_KEYS = 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with classes, which has one row a key and n, the rows of that key (left out of
    the result); total is the sum of n. Hot keys' classes, HOT_KEYS rows at most, are broadcast, so
    that the rows of a hot key stay where they are; the others meet by a shuffle."""
    hot = classes.where(F.col("n") * HOT_KEYS > total).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(F.col("n") * HOT_KEYS <= total).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def one_row_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """row (a whole row of docs, as a struct, so no name clashes) and wanted's columns, once for each
    row of wanted: o (id_order), h (hash of the text), more. Rows of docs that agree in id and text
    are taken once: each task keeps one of them before they are shuffled (the plan's WindowGroupLimit),
    so a group of copies, however large, brings one row a task."""
    keyed = docs.select(F.struct("*").alias("row"), id_order().alias("o2"), F.xxhash64("text").alias("h2"))
    single = keyed.withColumn("once", F.row_number().over(Window.partitionBy("o2", "h2").orderBy(F.lit(1)))).where("once = 1").drop("once")
    return single.join(wanted, (F.col("o2") == F.col("o")) & (F.col("h2") == F.col("h"))).select("row", *wanted.columns)
