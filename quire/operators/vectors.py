"""An inverted-list index of vectors: k-means lists, probing, and exact search that skips lists by bounds.

The centroids are fitted on a bounded sample (``sample`` vectors, those with the smallest hashes of their ids);
every vector then stands in the list of its nearest centroid. A list knows the least cosine of its members to
the centroid, so by the triangle inequality of angles no member is nearer to a query than a bound. A probing search
reads the ``probes`` nearest lists of each query. The exact one, the default, does that first and then reads
every other list whose bound reaches the k-th cosine found so far. What the driver holds are the sample while
it fits, and at most MOST_LISTS centroids, which go to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.sources.shared import materialized

MOST_LISTS = 4096
#: Rows of a list that meet queries in one task; a longer list is cut.
PART_ROWS = 50_000
#: Queries that meet a part of a list at once.
QUERY_ROWS = 1024
#: Cosines are compared as rounded, so a bound is one place looser.
DIGITS, SLACK = 6, 2e-6


@dataclass
class Index:
    """centroids: (lists, dim), of unit length; vectors: list, part, id, embedding; lists: list, parts, n, least (cosine)."""

    centroids: np.ndarray
    vectors: DataFrame
    lists: DataFrame


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def spherical_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of unit rows by cosine: k-means from k rows, an empty cluster restarts at the row that fits worst."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(rows, max(1, len(rows) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        fit = np.einsum("ij,ij->i", rows, centres[near])
        empty = np.flatnonzero(np.bincount(near, minlength=k) == 0)
        sums[empty] = rows[np.argsort(fit, kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix of doubles."""
    return np.stack([np.asarray(x, np.float64) for x in column.to_numpy(zero_copy_only=False)]) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that have a direction: not null, without null or NaN, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return vectors.where(F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))


def fit(vectors: DataFrame, lists: int | None = None, sample: int = 20_000) -> np.ndarray:
    """Centroids of vectors (id, embedding): about as many as the root of their number, MOST_LISTS at most."""
    good = usable(vectors)
    known = good.select("embedding").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("embedding").combine_chunks()
    if not len(known):
        return np.zeros((0, 0))
    wanted = lists or int(np.sqrt(good.count()))
    return spherical_means(_unit(_matrix(known)), max(1, min(wanted, MOST_LISTS, len(known))))


def build(vectors: DataFrame, lists: int | None = None, sample: int = 20_000) -> Index:
    """The index of vectors (id, embedding of one length). Vectors without a direction (null, or all zero) are in no
    list and in no result; repeated ids are vectors each. Without a usable vector there are no lists."""
    centroids = fit(vectors, lists, sample)
    good = usable(vectors).select("id", "embedding")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = _unit(_matrix(batch.column("embedding"))) @ centroids.T
                at = cosines.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(cosines[np.arange(len(at)), at], pa.float64())], names=[*batch.schema.names, "list", "cosine"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in good.schema)
    placed = materialized(good.mapInArrow(nearest, f"{kinds}, list int, cosine double") if len(centroids) else good.withColumns({"list": F.lit(0), "cosine": F.lit(0.0)}), "placed")
    sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    sizes = materialized(sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")), "lists")  # a row a list
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cut = placed.drop("cosine").join(F.broadcast(sizes.select("list", "parts")), "list").select("list", part.alias("part"), "id", "embedding")
    return Index(centroids, materialized(cut.repartition("list", "part").sortWithinPartitions("list", "part"), "inverted"), sizes)


def _reached(index: Index, queries: DataFrame, k: int, probes: int, known: DataFrame | None) -> DataFrame:
    """query_id, embedding, list: the probes nearest lists of each query; or, where known (query_id, reached: the k-th
    cosine, null if there are fewer) is given, the others whose bound reaches it."""
    centroids = index.centroids
    least = {r["list"]: r["least"] for r in index.lists.collect()}  # MOST_LISTS rows at most
    widest = np.array([np.arccos(np.clip(least.get(i, 1.0), -1, 1)) for i in range(len(centroids))])
    held = np.array([i in least for i in range(len(centroids))])
    by_bound = known is not None

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = np.where(held, _unit(_matrix(batch.column("embedding"))) @ centroids.T, -2.0)
            order = np.argsort(-cosines, axis=1, kind="stable")
            ranks = np.empty_like(order)
            np.put_along_axis(ranks, order, np.arange(order.shape[1])[None, :], axis=1)
            if not by_bound:
                wanted = (ranks < probes) & held
            else:
                angle = np.arccos(np.clip(cosines, -1, 1))
                bound = np.cos(np.maximum(angle - widest, 0))
                reached = np.array([-2.0 if x is None else x for x in batch.column("reached").to_pylist()])
                wanted = (ranks >= probes) & held & (bound >= reached[:, None] - SLACK)
            rows, lists = np.nonzero(wanted)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("embedding").take(at), pa.array(lists, pa.int32())], names=["query_id", "embedding", "list"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.select("query_id", "embedding").schema)
    asked = queries if known is None else queries.join(known, "query_id", "left")
    return asked.mapInArrow(one, f"{kinds}, list int")


def _scored(id_kind: pa.DataType, query_kind: pa.DataType, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def one(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "id": [], "cosine": []}
        if vectors.num_rows and asked.num_rows:
            rows = _unit(_matrix(vectors.column("embedding").combine_chunks()))
            ids = vectors.column("id").to_pylist()
            for lo in range(0, asked.num_rows, QUERY_ROWS):
                some = asked.slice(lo, QUERY_ROWS)
                cosines = np.round(_unit(_matrix(some.column("embedding").combine_chunks())) @ rows.T, DIGITS)
                for name, line in zip(some.column("query_id").to_pylist(), cosines, strict=True):
                    cut = np.partition(line, -k)[-k] if len(line) > k else -2.0
                    best = sorted(((-line[i], ids[i]) for i in np.flatnonzero(line >= cut)), key=lambda x: x)[:k]
                    found["query_id"] += [name] * len(best)
                    found["id"] += [i for _, i in best]
                    found["cosine"] += [-c for c, _ in best]
        return pa.table([pa.array(found["query_id"], query_kind), pa.array(found["id"], id_kind), pa.array(found["cosine"], pa.float64())], names=list(found))

    return one


def _read(index: Index, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, id, cosine: of each query the k nearest of each part of its lists."""
    parts = index.lists.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = pairs.join(F.broadcast(parts), "list")
    kinds = index.vectors.schema["id"].dataType, pairs.schema["query_id"].dataType
    ddl = f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, cosine double"
    return index.vectors.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(_scored(*map(to_arrow_type, kinds), k), ddl)


def search(index: Index, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
    """queries: query_id, embedding. The k nearest of each by cosine, rounded to DIGITS places, ties to the smaller
    id: query_id, id, cosine, rank. With probes, among the vectors of so many lists; without, exactly. A query without a
    direction finds nothing; one whose id is repeated should not be."""
    asked = usable(queries).select("query_id", "embedding")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {index.vectors.schema['id'].dataType.simpleString()}, cosine double, rank int"
    if not len(index.centroids):
        return asked.sparkSession.createDataFrame([], kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = probes or max(1, round(len(index.centroids) ** 0.5))
    near = _read(index, _reached(index, asked, k, first, None), k)
    if probes is None:
        near = materialized(best(near).drop("rank"), "near")
        known = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("reached"))
        near = near.unionByName(_read(index, _reached(index, asked, k, first, known), k))
    return best(near).select("query_id", "id", "cosine", "rank")


def tuned_probes(index: Index, queries: DataFrame, k: int = 5, target: float = 0.92, most: int = 256) -> int:
    """The fewest probes that find the target share of the exact hits of a sample of the queries (``most``, those with
    the smallest hashes of their ids): what matters of an exact hit is the rank of its list."""
    some = materialized(usable(queries).select("query_id", "embedding").orderBy(F.xxhash64("query_id"), "query_id").limit(most), "asked")
    hits = search(index, some, k).join(index.vectors.select("id", "list"), "id").select("query_id", "list").collect()  # most * k rows
    asked = {r["query_id"]: r["embedding"] for r in some.collect()}
    if not hits:
        return 1
    cosines = {q: index.centroids @ _unit(np.array([e], np.float64))[0] for q, e in asked.items()}
    ranks = sorted(int((cosines[r["query_id"]] > cosines[r["query_id"]][r["list"]]).sum()) for r in hits)
    return ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)] + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, found: how many of the exact hits of each query are among the found ones."""
    hits = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return exact.join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
