"""A training corpus from raw documents, in five stages.

Each stage takes the rows that the one before it kept, applies one operator of
``quire.llm`` to all of them, and returns the columns of ``documents`` (the last one:
packed pieces). run() writes each stage's rows as Parquet in the shared folder and
reads them again, so a stage's plan starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, packing, pii, quality_rules, simhash
from quire.llm.common import documents, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; rows with null ids and repeated
    rows are judged by their text; an empty table stays empty; all columns are kept as they are."""
    ratios = quality_rules.fit(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality_rules.keep(docs, ratios)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: the smallest id, null ids last. Texts without a
    word are one group, repeated rows become one, an empty table stays empty."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. Null and empty texts stay as they are, repeated
    rows stay repeated, long texts are read whole, an empty table stays empty."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most. A null source is a source; texts without words
    add nothing to the budget; ties are settled by a hash; an empty table stays empty."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in length buckets and batches. A null or empty text is one piece of no words in bucket 0; long
    texts are cut, not dropped; repeated rows are packed each; an empty table gives no piece."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: The log-likelihood ratios hash with XXH64 and the fingerprints are XXH64 majorities, which
#: DuckDB doesn't have: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
