"""Vector rows and jobs: building, embedding, upserts, sequences, merged status lists."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType


def hashing_embedder(texts: list[str], dim: int = 64) -> np.ndarray:
    """Deterministic stand-in for a model: signed hashed words, unit length (zero for no words)."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1.0 if h >> 31 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(rows: DataFrame, text: str, when: Column | None = None, embed: Callable[[list[str]], np.ndarray] = hashing_embedder, batch: int = 32) -> DataFrame:
    """Adds embedding (array<float>): of the texts for which ``when`` holds, else null. The model is
    called with ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        todo = [i for i, t in enumerate(x) if t is not None]
        for at in range(0, len(todo), batch):
            part = todo[at : at + batch]
            for i, v in zip(part, embed([x.iloc[j] for j in part]), strict=True):
                out[i] = v
        return pd.Series(out)

    source = F.col(text) if when is None else F.when(when, F.col(text))
    return rows.withColumn("embedding", run(source))


def vector_rows(chunks: DataFrame, model: str = "hashing", doc_type: str = "book") -> DataFrame:
    """Chunks as pending vector rows; the id is a hash of document, chunk and model."""
    key = F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.lit(model)), 256)
    return chunks.withColumn("id", F.substring(key, 1, 32)).withColumn("model_name", F.lit(model)).withColumn("doc_type", F.lit(doc_type)).withColumn("status", F.lit("pending"))


def completed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("embedding").isNotNull(), "completed").otherwise(F.col("status")))


def replaced(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Delete then insert: rows of the table with a key of the new rows go, the new ones come."""
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows)


def upserted(table: DataFrame, rows: DataFrame, *key: str, newest: str) -> DataFrame:
    """The row of each key that is newest; a new row wins a tie."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    best = both.groupBy(*key).agg(F.max_by(F.struct(*both.columns), F.struct(newest, "_new")).alias("r"))
    return best.select("r.*").drop("_new")


def new_by_hash(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose content_hash the table lacks, the first of each hash (by id)."""
    fresh = rows.join(table.select("content_hash").distinct(), "content_hash", "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy("content_hash").orderBy("id"))).where("_r = 1").drop("_r")


def linked_by_hash(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row's id with the oldest row of the table of the same hash (null: none)."""
    first = table.groupBy("content_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("existing_id"))
    return rows.select("id", "content_hash").join(first, "content_hash", "left").select("id", "existing_id")


def sequenced(jobs: DataFrame) -> DataFrame:
    """seq_id for jobs that have none: after the largest one, by created_at (nulls last), doc_id. Jobs are
    numbered inside their day, and days add up, so no task orders them all."""
    last = jobs.agg(F.coalesce(F.max("seq_id"), F.lit(0)).alias("last")).first().last
    missing = jobs.where("seq_id IS NULL").withColumn("day", F.to_date("created_at"))
    before = Window.orderBy(F.col("day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = missing.groupBy("day").agg(F.count("*").alias("n")).select(F.col("day").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = missing.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy("created_at", "doc_id"))).join(days, F.col("day").eqNullSafe(F.col("d")))
    numbered = inside.withColumn("seq_id", (F.col("r") + F.col("before") + last).cast(jobs.schema["seq_id"].dataType))
    return jobs.where("seq_id IS NOT NULL").unionByName(numbered.select(*jobs.columns))


def pair_rows(pairs: DataFrame, doc_type: str, roles: tuple[str, str]) -> DataFrame:
    """pairs: doc_id, pair, two texts named by the roles. Two candidate rows for each pair: the first role
    at chunk 0, the second at chunk 1; ids and pair_id are hashes, so a second run gives the same."""
    parts = [F.struct(F.lit(i).alias("chunk_index"), F.lit(role).alias("role"), F.col(role).alias("chunk_text")) for i, role in enumerate(roles)]
    key = lambda *c: F.substring(F.sha2(F.concat_ws("\x1f", F.lit(doc_type), F.col("doc_id").cast("string"), F.col("pair").cast("string"), *c), 256), 1, 32)
    rows = pairs.select("doc_id", "pair", F.explode(F.array(*parts)).alias("x")).select("doc_id", "pair", "x.*").where("chunk_text IS NOT NULL")
    return rows.withColumn("id", key(F.col("role"))).withColumn("pair_id", key()).withColumn("content_hash", F.sha2("chunk_text", 256)).withColumn("doc_type", F.lit(doc_type))


def ingested_pairs(table: DataFrame, candidates: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """New rows and links of candidates (pair_rows). Of one text the row that the table (id, content_hash,
    created_at) holds, the oldest, else the first candidate by doc_id, pair, chunk is the only one. Rows
    of chunk 0 are embedded, the others stay without a vector. Links: every candidate with row_id, the
    row that holds its text, and is_new."""
    known = table.groupBy("content_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("known_id"))
    first = candidates.groupBy("content_hash").agg(F.min_by("id", F.struct("doc_id", "pair", "chunk_index")).alias("first_id"))
    owners = first.join(known, "content_hash", "left").select("content_hash", F.coalesce("known_id", "first_id").alias("row_id"))
    linked = candidates.join(owners, "content_hash").withColumn("is_new", F.col("id") == F.col("row_id"))
    rows = embedded(linked.where("is_new").drop("row_id", "is_new"), "chunk_text", F.col("chunk_index") == 0, embed)
    rows = rows.withColumn("status", F.when(F.col("chunk_index") == 0, "embedded").otherwise("not_embedded"))
    return rows, linked.select("doc_id", "pair", "pair_id", "role", "row_id", "is_new")


def synced(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Nodes with their job's seq_id and file_name; their own where there is no job."""
    j = jobs.select("doc_id", F.col("seq_id").alias("_s"), F.col("file_name").alias("_f"))
    return nodes.join(j, "doc_id", "left").withColumn("seq_id", F.coalesce("_s", "seq_id")).withColumn("file_name", F.coalesce("_f", "file_name")).drop("_s", "_f")


def last_of_each(rows: DataFrame, *key: str, order: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The row of each key that comes last by order; of rows that tie, the first by the columns of ties, which are left
    out of the result."""
    last = Window.partitionBy(*key).orderBy(F.desc(order), *ties)
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", *ties)


def clustered(rows: DataFrame, *order: str) -> DataFrame:
    """Range-partitioned and sorted inside the partitions, for writing."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def page(rows: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def upserted_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs (doc_id, file_name, status, error_message) with the new ones; a null keeps the old value, and
    a completed job has no error."""
    n = new.select("doc_id", *(F.col(c).alias(f"n_{c}") for c in ("file_name", "status", "error_message")))
    j = jobs.join(n, "doc_id", "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c))
    return j.select("doc_id", pick("file_name").alias("file_name"), pick("status").alias("status"), F.when(F.col("n_status") == "completed", F.lit(None)).otherwise(pick("error_message")).alias("error_message"))


def unfinished(listed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Listed documents that no completed job has."""
    return listed.join(jobs.where("status = 'completed'").select("doc_id"), "doc_id", "left_anti")


def status_list(jobs: DataFrame, vectors: DataFrame, limit: int = 100, oldest: bool = False) -> DataFrame:
    """Jobs and vector documents in one list, newest first; path is structure, vector or hybrid. oldest:
    the first limit jobs by seq_id are merged, not the newest."""
    some = jobs.orderBy("seq_id" if oldest else F.desc("seq_id")).limit(limit)
    v = vectors.groupBy("doc_id").agg(F.max("created_at").alias("v_created"), F.count("*").alias("n_vectors"), F.bool_and(F.col("status") == "completed").alias("done"))
    both = some.withColumnRenamed("status", "j_status").join(v, "doc_id", "full_outer")
    path = F.when(F.col("j_status").isNotNull() & F.col("n_vectors").isNotNull(), "hybrid").when(F.col("j_status").isNotNull(), "structure").otherwise("vector")
    status = F.coalesce("j_status", F.when(F.col("done"), "completed").otherwise("pending"))
    out = both.select("doc_id", path.alias("path"), status.alias("status"), F.coalesce("n_vectors", F.lit(0)).alias("n_vectors"), F.coalesce("created_at", "v_created").alias("created_at"))
    return out.orderBy(F.desc("created_at"), "doc_id").limit(limit)


#: Vectors of one product, and the queries that it takes at a time.
PART_VECTORS, QUERY_ROWS = 16_384, 256


def _matrices(table: pa.Table, at: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the rows of a column of vectors that have no null in them, and their matrix."""
    lists = table.column(at).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in set(sizes[sizes > 0].tolist()):
        rows = np.flatnonzero(sizes == n)
        values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        nulls = lists.take(pa.array(rows)).flatten().is_null().to_numpy(zero_copy_only=False).reshape(-1, n).any(axis=1)
        out[n] = rows[~nulls], values[~nulls].astype(np.float64)
    return out


def _nearest(k: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of the vectors (block, part, id, e) and queries (block, part, query_id, qe) of one group: the k nearest of each query."""

    def one(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors = vectors.take(pc.sort_indices(vectors, [("id", "ascending")]))  # ties go to the smaller id
        sides = _matrices(vectors, 3), _matrices(queries, 3)
        at, ids, cosines = [], [], []
        for first in range(0, queries.num_rows, QUERY_ROWS):
            n = min(QUERY_ROWS, queries.num_rows - first)
            cosine, known = np.zeros((n, vectors.num_rows)), np.zeros((n, vectors.num_rows), bool)
            for size, (rows, e) in sides[0].items():
                asked, q = sides[1].get(size, (np.array([], int), e[:0]))
                mine = (asked >= first) & (asked < first + n)
                place = np.ix_(asked[mine] - first, rows)
                norms = np.sqrt((q[mine] ** 2).sum(axis=1))[:, None] * np.sqrt((e**2).sum(axis=1))[None, :]
                with np.errstate(all="ignore"):
                    c = (q[mine] @ e.T) / norms
                cosine[place], known[place] = np.sign(c) * np.floor(np.abs(c) * 1e6 + 0.5) / 1e6, norms != 0
            order = np.where(known, np.where(np.isnan(cosine), np.inf, cosine), -np.inf)
            last = min(k, vectors.num_rows)
            least = np.partition(order, vectors.num_rows - last, axis=1)[:, vectors.num_rows - last]
            for i in range(n):
                more, same = np.flatnonzero(order[i] > least[i]), np.flatnonzero(order[i] == least[i])
                hits = np.concatenate([more, same[: last - len(more)]])
                at.append(np.full(last, first + i))
                ids.append(hits)
                cosines.append(pa.array(cosine[i, hits], mask=~known[i, hits]))
        return pa.table([queries.column(2).take(pa.array(np.concatenate(at))), vectors.column(2).take(pa.array(np.concatenate(ids))), pa.concat_arrays(cosines)], ["query_id", "id", "cosine"])

    return one


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, most: int = 1024, parts: int = 32) -> DataFrame:
    """vectors: id, embedding; queries: query_id, embedding (a stated query set). The k nearest of each
    query by cosine, in double precision: query_id, id, cosine, rank. An extension: the index this
    stands for is only declared, never searched. Both are counted: blocks of about ``most`` queries meet ``parts``
    parts of the vectors, more where these would be long, as products of matrices, and k candidates of a query and part
    go on to the ranking. A cosine is null where a vector is null, has a null or no length, or the lengths differ."""
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    parts = max(parts, -(-vectors.count() // PART_VECTORS))
    blocks = max(1, -(-queries.count() // most))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(every(blocks).alias("block"), dealt("id", parts).alias("part"), "id", d("embedding").alias("e"))
    q = queries.select(dealt("query_id", blocks).alias("block_"), every(parts).alias("part_"), "query_id", d("embedding").alias("qe"))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", vectors.schema["id"].dataType), StructField("cosine", DoubleType())])
    near = v.groupBy("block", "part").cogroup(q.groupBy("block_", "part_")).applyInArrow(_nearest(k, to_arrow_schema(schema)), schema)
    order = [F.desc("cosine"), F.col("id")]
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "id", "cosine", "rank")
