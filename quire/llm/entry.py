"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import class_lm, conversations, exact_dedup, language_id, media, merkle, mixing, packing, pii, quality_rules, simhash, substring_dedup, toxicity
from quire.llm.common import documents, id_remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(id_remainder(5) != 0))
    out = language_id.identify(docs, model)
    return out.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(id_remainder(5) != 0)
    model = toxicity.fit(docs.where(id_remainder(5) != 0), labels)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_lm_scores(documents(spark, sf_dir), id_remainder(10) == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ratios = quality_rules.fit(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality_rules.judge(docs, ratios)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).withColumn("words", F.sha2("words", 256)).withColumnRenamed("words", "words_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(documents(spark, sf_dir)))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(documents(spark, sf_dir), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_class_lm": op3_class_lm,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_media_columns": op10_media_columns,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op9_mixing": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_conversation_repair": conversations.ORACLE,
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, range(1, len(w) - 48) AS r(i) WHERE len(w) >= 50),
        least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT doc_id, i FROM win JOIN least USING (h) WHERE m < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
        sets AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
