"""Sources and sinks: saved trees, texts, object folders, tables, index files, settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.shared import materialized

NODE = "doc_id string, node_id string, parent_id string, ordinal long, title string, text string, summary string, page_start int, page_end int"
NODE_COLUMNS = [x.split()[0] for x in NODE.split(", ")]


def page_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines extracted before, as Parquet with the columns of the line table."""
    return spark.read.parquet(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: doc_id (the file's name without its ending), text."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("text"))


def page_texts(pages: DataFrame, by: str = "\n\n") -> DataFrame:
    """doc_id, text: a document's stripped, non-empty pages, joined in order."""
    p = pages.select("doc_id", "page", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), by).alias("text"))


def objects(spark: SparkSession, root: str, stem: str) -> DataFrame:
    """doc_id, path, length of the objects under root/cleaned/stem/doc_id/; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/cleaned/{stem}").select("path", "length")
    return files.withColumn("doc_id", F.regexp_extract("path", rf"/cleaned/{stem}/(?:.*/)?([^/]+)/[^/]+$", 1)).where("doc_id <> ''").select("doc_id", "path", "length")


def object_of(listed: DataFrame, doc_id: str) -> DataFrame:
    """The first PDF of a document, by path, as one row."""
    return listed.where(F.col("path").endswith(".pdf") & F.col("path").contains(f"/{doc_id}/")).orderBy("path").limit(1)


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _told(node: str, keys: tuple[str, ...]) -> str:
    """SQL: the first of a node's keys whose value says something: not missing, null, empty, 0 or false."""
    return "coalesce(" + ", ".join(f"nullif(nullif(nullif(try_variant_get({node}, '$.{k}', 'string'), ''), '0'), 'false')" for k in keys) + ")"


def trees(saved: DataFrame) -> DataFrame:
    """saved: doc_id, json (one tree a row: a list of nodes, {'nodes': [...]}, or one node). One row a node: ids by
    place in the document, depth first, parents, title, text, summary, pages. A document without JSON has no rows.

    The JSON is parsed once into a VARIANT and unfolded level by level, as long as a level has nodes: nodes that
    stand in a list of their parent's. A node's place is the path of positions to it, so places sort depth first.
    """
    nodes_of = lambda v: F.expr(f"CASE WHEN schema_of_variant(variant_get({v}, '$.nodes')) LIKE 'ARRAY%' THEN try_variant_get({v}, '$.nodes', 'array<variant>') END")
    whole = saved.where("trim(coalesce(json, '')) <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), F.expr("parse_json(json)").alias("v"))
    listed = F.expr("CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN CAST(v AS array<variant>) END")
    untitled = F.expr(f"{_told('v', ('title',))} IS NULL")
    top = F.coalesce(listed, F.when(untitled, nodes_of("v")), F.array("v"))
    level = whole.select("doc_id", F.posexplode(top).alias("i", "v")).select("doc_id", F.array("i").alias("place"), "v")
    found = []
    while True:
        level = materialized(level, "tree-level")
        if level.isEmpty():
            break
        found.append(level)
        level = level.select("doc_id", "place", F.posexplode(nodes_of("v")).alias("i", "v")).select("doc_id", F.concat("place", F.array("i")).alias("place"), "v")
    if not found:
        return saved.sparkSession.createDataFrame([], NODE)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("doc_id").orderBy("place")
    told = lambda *keys: F.expr(_told("v", keys))
    number = lambda *keys: F.coalesce(told(*keys).cast("double").cast("int"), F.lit(0))
    start = number("page_start", "start_index", "page_index", "physical_index")
    rows = every.select("doc_id", "place", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), F.regexp_replace(F.coalesce(told("title"), F.lit("")), r"^\s+|\s+$", "").alias("title"), F.coalesce(told("raw_content", "text", "content"), F.lit("")).alias("text"), F.coalesce(told("summary", "prefix_summary", "micro_summary"), F.lit("")).alias("summary"), start.alias("page_start"), F.greatest(start, number("page_end", "end_index")).alias("page_end"))
    rows = materialized(rows.withColumn("node_id", F.format_string("%04d", F.col("ordinal") + 1)), "tree-nodes")
    ups = rows.select(F.col("doc_id"), F.col("place").alias("up"), F.col("node_id").alias("parent_id"))
    up = F.when(F.size("place") > 1, F.slice("place", 1, F.size("place") - 1))
    return rows.withColumn("up", up).join(ups, ["doc_id", "up"], "left").select(*(F.col(c) for c in NODE_COLUMNS))


def write_index(nodes: DataFrame, path: str) -> None:
    """One JSON object a node, nulls kept, letters as they are; partitioned by document when read back."""
    nodes.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


@dataclass(frozen=True)
class Settings:
    """Build settings; from_options refuses unknown keys, from_env reads QUIRE_<NAME>."""

    compression_target_ratio: float = 0.70
    compression_min_ratio: float = 0.60
    overlap_reject_threshold: float = 0.85
    overlap_adjacent_threshold: float = 0.15
    max_chunk_chars: int = 6000
    max_title_chars: int = 85
    vector_chunk_size: int = 1000
    vector_chunk_overlap: int = 200

    @classmethod
    def from_options(cls, options: dict) -> Settings:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := sorted(set(options) - set(kinds)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: kinds[k](v) for k, v in options.items()})

    @classmethod
    def from_env(cls) -> Settings:
        found = {f.name: os.environ[f"QUIRE_{f.name.upper()}"] for f in fields(cls) if f"QUIRE_{f.name.upper()}" in os.environ}
        return cls.from_options(found)
