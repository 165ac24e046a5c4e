"""Ingestion, store and window queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import register
from quire.functions import rules as r
from quire.operators import chunking, store, tree, vectors
from quire.plans import usage as up
from quire.plans.text import NOTICES, _values
from quire.sources import files
from quire.streaming import ingest as stream
from quire.streaming import jobs

PAGES = [("a", 1, "cover"), ("a", 2, NOTICES[0]), ("a", 3, "more of the notice"), ("a", 4, "GST / REPLY and GST / NOTICE"), ("a", 5, "gst / reply\nWe deny it"), ("b", 1, "GST / REPLY only"), ("c", 1, "nothing")]
FAQS = [("f", "Q: What is it?\nA: A form.\nQuestion - When is it due?\nAnswer: On the 11th.\nQ: Empty?\nA: \n"), ("g", "no pairs here"), ("h", "Q: One?\nA: Yes.")]


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _pages(s: SparkSession) -> DataFrame:
    return s.createDataFrame(PAGES, "doc_id string, page int, text string")


def _jobs(s: SparkSession, d: str) -> DataFrame:
    o = _t(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("seq_id"), F.concat(F.lit("f"), F.col("o_orderkey")).alias("file_name"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.when(F.col("o_orderstatus") != "F", "slow").alias("error_message"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate")).alias("created_at"))


_JOBS = "jobs AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS seq_id, 'f' || o_orderkey AS file_name, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status, CASE WHEN o_orderstatus <> 'F' THEN 'slow' END AS error_message, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS created_at FROM orders)"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    x = _t(s, d, "documents")
    return x.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 7).alias("doc_id"), F.md5("text").alias("content_hash"), (F.col("doc_id") % 5 > 0).cast("string").alias("status"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at")).withColumn("status", F.when(F.col("status") == "true", "completed").otherwise("pending"))


_VECTORS = "vec AS (SELECT doc_id AS id, doc_id * 7 AS doc_id, md5(text) AS content_hash, CASE WHEN doc_id % 5 > 0 THEN 'completed' ELSE 'pending' END AS status, TIMESTAMP '2024-01-01' AS created_at FROM documents)"


def _queries(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _chunked(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(_t(s, d, "documents").select("doc_id", "text"))


def _pairs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions and answers of all conversations, against a table of those of every seventh one."""
    c = _t(s, d, "conversations")
    old = c.where("conv_id % 7 = 0 AND text IS NOT NULL").select(F.concat_ws("-", F.lit("old"), "conv_id", "turn").alias("id"), F.sha2("text", 256).alias("content_hash"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    asked = chunking.dialogue_pairs(c).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pair"), "question", "answer")
    return store.ingested_pairs(old, store.pair_rows(asked, "faq", ("question", "answer")))


_PAIRS = """a AS (SELECT conv_id AS doc_id, turn AS pair, text AS question, nt AS answer FROM (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'),
    b AS (SELECT doc_id, pair, 0 AS chunk_index, 'question' AS role, question AS t FROM a UNION ALL SELECT doc_id, pair, 1, 'answer', answer FROM a),
    c AS (SELECT *, substring(sha256(concat_ws(chr(31), 'faq', doc_id, pair, role)), 1, 32) AS id, substring(sha256(concat_ws(chr(31), 'faq', doc_id, pair)), 1, 32) AS pair_id, sha256(t) AS h FROM b WHERE t IS NOT NULL),
    o AS (SELECT sha256(text) AS h, min('old-' || conv_id || '-' || turn) AS old FROM conversations WHERE conv_id % 7 = 0 GROUP BY 1),
    l AS (SELECT c.*, coalesce(old, first_value(id) OVER (PARTITION BY h ORDER BY doc_id, pair, chunk_index)) AS row_id FROM c LEFT JOIN o USING (h))"""


def _uploads(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 5 == 0, ".txt").otherwise(".PDF"))
    kind = F.when(k % 13 == 0, "memo").when(k % 3 == 0, "FAQ").when(k % 3 == 1, " book ")
    fault = chunking.upload_error(name, F.when(k % 11 == 0, "both").when(k % 2 == 0, "Vector"), kind, F.when(k % 17 > 0, k % 400), (k % 7) * 50 - 10, k % 4 == 0)
    return _t(s, d, "orders").select("o_orderkey", fault.alias("error"))


def _routed(s: SparkSession, d: str) -> DataFrame:
    """All documents as books, with the small notices and question lists."""
    x = _t(s, d, "documents")
    pages = x.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), "text").unionByName(_pages(s)).unionByName(s.createDataFrame([(i, 1, t) for i, t in FAQS], "doc_id string, page int, text string"))
    kinds = [(i, "notice_reply") for i in ("a", "b", "c")] + [(i, "FAQ ") for i, _ in FAQS]
    given = x.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("doc_type")).unionByName(s.createDataFrame(kinds, "doc_id string, doc_type string"))
    rows, _ = chunking.routed(pages, given, _vectors(s, d).select(F.col("id").cast("string").alias("id"), "content_hash", "created_at"))
    return rows.select("id", "doc_id", "doc_type", "role", "chunk_index", "status", F.size("embedding").alias("dim"))


def _searched(s: SparkSession, d: str, probed: bool) -> DataFrame:
    """The hits of the exact search over inverted lists, or how many of them a probing one finds."""
    rows = _t(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index, asked = vectors.build(rows), _queries(s, d)
    exact = vectors.search(index, asked)
    return vectors.recall(vectors.search(index, asked, probes=vectors.tuned_probes(index, asked)), exact) if probed else exact


def _windows(s: SparkSession, d: str) -> DataFrame:
    """The windows that a stream of the events has open or closed when it has read them all."""
    out = stream.drained(stream.credit_windows(up.streamed(s, d)), "windows", "complete")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).select(F.col("start").cast("timestamp_ntz").alias("start"), "operation", "credits", "n")


def _job_totals(s: SparkSession, d: str) -> DataFrame:
    """Each job's last totals from a stream of the events."""
    out = stream.drained(jobs.job_totals(up.streamed(s, d)), "job-totals", conf=jobs.STORE)
    last = out.groupBy("job_id").agg(F.max_by(F.struct("events", "credits_nano", "retries"), "events").alias("t"), F.max("alert").alias("alert"))
    return last.select("job_id", "t.*", "alert")


def _saved_trees(s: SparkSession, d: str) -> DataFrame:
    """A JSON tree for each nation (region, nation, customers, orders), and the rows that it unfolds to."""
    region, nation, customer, orders = (_t(s, d, t) for t in ("region", "nation", "customer", "orders"))
    key = F.col("n_nationkey").cast("string").alias("doc_id")
    n = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    c = customer.withColumnRenamed("c_nationkey", "n_nationkey")
    o = orders.join(c.select("c_custkey", "n_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    row = lambda df, node, parent, ordinal, title, text, start: df.select(key, node.alias("node_id"), parent.alias("parent_id"), ordinal.cast("long").alias("ordinal"), title.alias("title"), text.cast("string").alias("text"), start.cast("int").alias("page_start"))
    own, no, of = lambda c: F.concat(F.lit("c"), c), F.lit(None).cast("string"), F.col
    every = row(n, F.lit("r"), no, F.lit(0), of("r_name"), no, no)
    every = every.unionAll(row(n, F.lit("n"), F.lit("r"), F.lit(0), F.concat(F.lit(" "), of("n_name")), F.lit(""), F.lit(0)))
    every = every.unionAll(row(c, own(of("c_custkey")), F.lit("n"), of("c_custkey"), of("c_name"), of("c_mktsegment"), of("c_custkey") % 50))
    every = every.unionAll(row(o, F.concat(F.lit("o"), of("o_orderkey")), own(of("o_custkey")), of("o_orderkey"), of("o_orderpriority"), of("o_orderstatus"), of("o_orderkey") % 50))
    every = every.withColumn("page_end", F.col("page_start") + F.col("ordinal") % 3 - 1)
    return files.trees(tree.nested(every.withColumn("type", F.lit("")), ("title", "text", "page_start", "page_end")).withColumnRenamed("tree", "json"))


def _chunks_by_sql(s: SparkSession, d: str) -> DataFrame:
    """Sliding windows by a table function in SQL, next to the session's functions."""
    register.register(s)
    register.register_tables(s)
    _t(s, d, "documents").createOrReplaceTempView("chunked_documents")
    return s.sql("SELECT doc_id, chunk_index, chunk_text, content_hash(chunk_text) AS hash FROM chunked_documents, LATERAL sliding_chunks(text, 1000, 200)")


QUERIES = {
    "ingest_pair_rows": lambda s, d: _pairs(s, d)[0].select("id", "doc_id", "pair_id", "role", "status", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim")),
    "ingest_pair_links": lambda s, d: _pairs(s, d)[1],
    "ingest_upload_errors": _uploads,
    "ingest_routed": _routed,
    "ingest_chunks": _chunked,
    "ingest_vector_rows": lambda s, d: store.completed(store.embedded(store.vector_rows(_chunked(s, d)), "chunk_text", F.col("chunk_index") % 2 == 0)).select("id", "doc_id", "chunk_index", "status", F.size("embedding").alias("dim")),
    "ingest_notice_pages": lambda s, d: chunking.notice_pages(_pages(s)).select("doc_id", "page", "part"),
    "ingest_notices": lambda s, d: chunking.notices(_pages(s)),
    "ingest_faq_pairs": lambda s, d: chunking.faq_pairs(s.createDataFrame(FAQS, "doc_id string, text string")),
    "ingest_dialogue_pairs": lambda s, d: chunking.dialogue_pairs(_t(s, d, "conversations")),
    "ingest_page_texts": lambda s, d: files.page_texts(_pages(s)),
    "ingest_saved_trees": _saved_trees,
    "ingest_chunks_by_sql": _chunks_by_sql,
    "store_sequenced": lambda s, d: store.sequenced(_jobs(s, d)).select("doc_id", "seq_id"),
    "store_new_by_hash": lambda s, d: store.new_by_hash(_vectors(s, d).where("id % 2 = 0"), _vectors(s, d)).select("id", "content_hash"),
    "store_linked_by_hash": lambda s, d: store.linked_by_hash(_vectors(s, d).where("id % 2 = 0"), _vectors(s, d)),
    "store_replaced": lambda s, d: store.replaced(_vectors(s, d), _vectors(s, d).where("id % 9 = 0").withColumn("status", F.lit("new")), "doc_id").select("id", "status"),
    "store_upserted": lambda s, d: store.upserted(_vectors(s, d), _vectors(s, d).where("id % 4 = 0").withColumn("status", F.lit("new")).withColumn("created_at", F.when(F.col("id") % 8 == 0, F.lit("2023-01-01").cast("timestamp_ntz")).otherwise(F.col("created_at"))), "doc_id", newest="created_at").select("id", "status"),
    "store_upserted_jobs": lambda s, d: store.upserted_jobs(_jobs(s, d).select("doc_id", "file_name", "status", "error_message"), _jobs(s, d).where("doc_id % 5 = 0").select((F.col("doc_id") * 2).alias("doc_id"), F.lit(None).cast("string").alias("file_name"), "status", F.lit("again").alias("error_message"))),
    "store_unfinished": lambda s, d: store.unfinished(_vectors(s, d).select("doc_id"), _jobs(s, d)),
    "store_status_list": lambda s, d: store.status_list(_jobs(s, d).where("seq_id IS NOT NULL"), _vectors(s, d)),
    "store_status_oldest": lambda s, d: store.status_list(_jobs(s, d).where("seq_id IS NOT NULL"), _vectors(s, d), oldest=True),
    "store_page": lambda s, d: store.page(_jobs(s, d), 20, 10, F.col("seq_id").asc_nulls_last(), "doc_id").select("doc_id", "seq_id"),
    "store_synced": lambda s, d: store.synced(_vectors(s, d).select("id", "doc_id").withColumn("seq_id", F.lit(-1).cast("long")).withColumn("file_name", F.lit("own")), _jobs(s, d)),
    # line numbers repeat in an order: of equal ones the first in the files stays, as in SQL
    "store_last_of_each": lambda s, d: store.last_of_each(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")), "l_orderkey", order="l_linenumber", ties=("file", "place")),
    "store_cosine_top_k": lambda s, d: store.cosine_top_k(_t(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), _queries(s, d)).select("query_id", "id", "cosine", "rank"),
    "vectors_exact": lambda s, d: _searched(s, d, False),
    "vectors_probed_recall": lambda s, d: _searched(s, d, True),
    "stream_credit_windows": _windows,
    "stream_job_totals": _job_totals,
    "stream_job_sessions": lambda s, d: stream.job_sessions(up.events(s, d)).select("job_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "credits"),
}
_P = f"p AS (SELECT * FROM {_values(PAGES)} v(doc_id, page, text)), m AS (SELECT *, CASE WHEN contains(upper(text), 'GST / NOTICE') THEN 'notice' WHEN contains(upper(text), 'GST / REPLY') THEN 'reply' END AS mark FROM p), s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page) AS part FROM m)"
#: Windows of 1000 characters, each after the first 200 before the end of the one before; a window that isn't the last
#: ends after the last of the first kind of break that it holds, unless that lies in its first third.
_AT = lambda b: f"CASE WHEN strpos(reverse(win), reverse({b})) > 0 THEN length(win) - strpos(reverse(win), reverse({b})) + 1 END"
_BREAKS = ", ".join(_AT(x) for x in ("chr(10) || chr(10)", "'. '", "'? '", "'! '", "'.' || chr(10)", "'?' || chr(10)", "'!' || chr(10)", "chr(10)", "' '"))
_CHUNKS = f"""WITH RECURSIVE t0 AS (SELECT doc_id, {r.DUCK.strip("regexp_replace(coalesce(text, ''), '[ ' || chr(9) || ']+', ' ', 'g')")} AS x FROM documents), t AS (SELECT doc_id, regexp_replace(x, chr(10) || '{{3,}}', chr(10) || chr(10), 'g') AS x FROM t0),
    c AS (SELECT doc_id, 0 AS start, -1 AS stop, '' AS win FROM t UNION ALL SELECT doc_id, nxt, CAST(CASE WHEN nxt + 1000 < n AND at_ >= 333 THEN nxt + at_ ELSE nxt + 1000 END AS INT), win
        FROM (SELECT *, coalesce({_BREAKS}) AS at_ FROM (SELECT c.doc_id, length(x) AS n, CASE WHEN stop < 0 THEN 0 ELSE greatest(0, stop - 200) END AS nxt, substr(x, CASE WHEN stop < 0 THEN 0 ELSE greatest(0, stop - 200) END + 1, 1000) AS win FROM c JOIN t USING (doc_id) WHERE stop < length(x)) q) p),
    p AS (SELECT doc_id, start, {r.DUCK.strip("substr(win, 1, stop - start)")} AS chunk_text FROM c WHERE stop >= 0),
    k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS chunk_index, chunk_text FROM p WHERE chunk_text <> '')"""
ORACLE_SQL = {
    "ingest_chunks": f"{_CHUNKS} SELECT doc_id, chunk_index, chunk_text, sha256(chunk_text) AS content_hash, {r.tokens_ceil(r.DUCK, 'chunk_text')} AS token_count FROM k",
    "ingest_chunks_by_sql": f"{_CHUNKS} SELECT doc_id, chunk_index, chunk_text, {r.content_hash(r.DUCK, 'chunk_text')} AS hash FROM k",
    "ingest_saved_trees": """WITH n AS (SELECT * FROM nation JOIN region ON r_regionkey = n_regionkey), t AS (
            SELECT n_nationkey AS doc, 0 AS a, -1 AS c, -1 AS o, r_name AS title, '' AS text, 0 AS page_start, 0 AS page_end FROM n UNION ALL SELECT n_nationkey, 1, -1, -1, n_name, '', 0, 0 FROM n
            UNION ALL SELECT c_nationkey, 2, c_custkey, -1, c_name, c_mktsegment, c_custkey % 50, c_custkey % 50 + c_custkey % 3 - 1 FROM customer
            UNION ALL SELECT c_nationkey, 2, c_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_orderkey % 50, o_orderkey % 50 + o_orderkey % 3 - 1 FROM orders JOIN customer ON c_custkey = o_custkey),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY a, c, o) - 1 AS ordinal FROM t)
        SELECT CAST(k.doc AS VARCHAR) AS doc_id, printf('%04d', k.ordinal + 1) AS node_id, CASE WHEN k.a = 1 THEN '0001' WHEN k.o >= 0 THEN printf('%04d', p.ordinal + 1) WHEN k.a = 2 THEN '0002' END AS parent_id, k.ordinal, k.title, k.text, '' AS summary, CAST(k.page_start AS INT) AS page_start, CAST(greatest(k.page_start, k.page_end) AS INT) AS page_end
        FROM k LEFT JOIN k p ON p.doc = k.doc AND p.c = k.c AND p.o = -1 AND p.a = 2 AND k.o >= 0""",
    "ingest_pair_rows": f"WITH {_PAIRS} SELECT id, doc_id, pair_id, role, CASE chunk_index WHEN 0 THEN 'embedded' ELSE 'not_embedded' END AS status, CASE chunk_index WHEN 0 THEN 64 ELSE -1 END AS dim FROM l WHERE id = row_id",
    "ingest_pair_links": f"WITH {_PAIRS} SELECT doc_id, pair, pair_id, role, row_id, id = row_id AS is_new FROM l",
    "ingest_upload_errors": """WITH u AS (SELECT o_orderkey AS k, CASE WHEN k % 17 > 0 THEN k % 400 ELSE 1000 END AS size, k % 7 * 50 - 10 AS over, k % 13 <> 0 AND k % 3 <> 0 AS book FROM orders)
        SELECT k AS o_orderkey, CASE WHEN k % 5 = 0 THEN 'Only PDF files are supported.' WHEN k % 11 = 0 THEN 'mode must be one of: pageindex, vector, hybrid' WHEN k % 13 = 0 THEN 'doc_type must be one of: book, notice_reply, faq'
        WHEN book AND size < 100 THEN 'chunk_size must be >= 100' WHEN book AND over < 0 THEN 'chunk_overlap must be >= 0' WHEN book AND over >= size AND k % 4 > 0 THEN 'chunk_overlap must be < chunk_size' END AS error FROM u""",
    "ingest_notice_pages": f"WITH {_P} SELECT doc_id, page, part FROM s WHERE part IS NOT NULL",
    "ingest_faq_pairs": f"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(?:Question|Q)\\s*[:\\-]\\s*', chr(30), 'g'), chr(30))[2:] AS qs FROM {_values(FAQS)} v(doc_id, text)), x AS (SELECT doc_id, unnest(range(len(qs))) AS pair, string_split(regexp_replace(unnest(qs), '(?i)(?:Answer|A)\\s*[:\\-]\\s*', chr(31)), chr(31)) AS qa FROM t)
        SELECT doc_id, CAST(pair AS INT) AS pair, regexp_replace(qa[1], '^\\s+|\\s+$', '', 'g') AS question, regexp_replace(qa[2], '^\\s+|\\s+$', '', 'g') AS answer FROM x WHERE trim(qa[2], chr(10) || ' ') <> ''""",
    "ingest_dialogue_pairs": "SELECT conv_id, turn, text AS question, nt AS answer FROM (SELECT *, lead(text) OVER w AS nt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'",
    "ingest_page_texts": f"SELECT doc_id, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY page) AS text FROM {_values(PAGES)} v(doc_id, page, text) GROUP BY doc_id",
    "store_sequenced": f"WITH {_JOBS} SELECT doc_id, coalesce(seq_id, (SELECT max(seq_id) FROM jobs) + row_number() OVER (PARTITION BY seq_id IS NULL ORDER BY created_at NULLS LAST, doc_id)) AS seq_id FROM jobs",
    "store_new_by_hash": f"WITH {_VECTORS} SELECT min(id) AS id, content_hash FROM vec WHERE content_hash NOT IN (SELECT content_hash FROM vec WHERE id % 2 = 0) GROUP BY content_hash",
    "store_linked_by_hash": f"WITH {_VECTORS}, o AS (SELECT content_hash, min(id) AS existing_id FROM vec WHERE id % 2 = 0 GROUP BY 1) SELECT id, existing_id FROM vec LEFT JOIN o USING (content_hash)",
    "store_replaced": f"WITH {_VECTORS} SELECT id, CASE WHEN id % 9 = 0 THEN 'new' ELSE status END AS status FROM vec",
    "store_upserted": f"WITH {_VECTORS} SELECT id, CASE WHEN id % 8 = 4 THEN 'new' ELSE status END AS status FROM vec",
    "store_upserted_jobs": f"WITH {_JOBS}, n AS (SELECT doc_id * 2 AS doc_id, status FROM jobs WHERE doc_id % 5 = 0) SELECT coalesce(j.doc_id, n.doc_id) AS doc_id, file_name, coalesce(n.status, j.status) AS status, CASE WHEN n.status = 'completed' THEN NULL WHEN n.doc_id IS NOT NULL THEN 'again' ELSE error_message END AS error_message FROM jobs j FULL JOIN n ON j.doc_id = n.doc_id",
    "store_unfinished": f"WITH {_JOBS}, {_VECTORS} SELECT doc_id FROM vec WHERE doc_id NOT IN (SELECT doc_id FROM jobs WHERE status = 'completed')",
    "store_status_list": f"WITH {_JOBS}, {_VECTORS}, s AS (SELECT * FROM jobs WHERE seq_id IS NOT NULL ORDER BY seq_id DESC LIMIT 100), v AS (SELECT doc_id, max(created_at) AS vc, count(*) AS n, bool_and(status = 'completed') AS done FROM vec GROUP BY 1) SELECT coalesce(s.doc_id, v.doc_id) AS doc_id, CASE WHEN s.doc_id IS NOT NULL AND v.doc_id IS NOT NULL THEN 'hybrid' WHEN s.doc_id IS NOT NULL THEN 'structure' ELSE 'vector' END AS path, coalesce(s.status, CASE WHEN done THEN 'completed' ELSE 'pending' END) AS status, coalesce(n, 0) AS n_vectors, coalesce(s.created_at, vc) AS created_at FROM s FULL JOIN v ON s.doc_id = v.doc_id ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 100",
    "store_status_oldest": f"WITH {_JOBS}, {_VECTORS}, s AS (SELECT * FROM jobs WHERE seq_id IS NOT NULL ORDER BY seq_id LIMIT 100), v AS (SELECT doc_id, max(created_at) AS vc, count(*) AS n, bool_and(status = 'completed') AS done FROM vec GROUP BY 1) SELECT coalesce(s.doc_id, v.doc_id) AS doc_id, CASE WHEN s.doc_id IS NOT NULL AND v.doc_id IS NOT NULL THEN 'hybrid' WHEN s.doc_id IS NOT NULL THEN 'structure' ELSE 'vector' END AS path, coalesce(s.status, CASE WHEN done THEN 'completed' ELSE 'pending' END) AS status, coalesce(n, 0) AS n_vectors, coalesce(s.created_at, vc) AS created_at FROM s FULL JOIN v ON s.doc_id = v.doc_id ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 100",
    "store_page": f"WITH {_JOBS} SELECT doc_id, seq_id FROM jobs ORDER BY seq_id NULLS LAST, doc_id LIMIT 10 OFFSET 20",
    "store_synced": f"WITH {_JOBS}, {_VECTORS} SELECT id, vec.doc_id, coalesce(seq_id, -1) AS seq_id, coalesce(file_name, 'own') AS file_name FROM vec LEFT JOIN jobs ON vec.doc_id = jobs.doc_id",
    "store_last_of_each": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1",
    "store_cosine_top_k": "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS c FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0) SELECT query_id, id, c AS cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS INT) AS rank FROM p QUALIFY rank <= 5",
    "stream_job_totals": "SELECT CAST(user_id AS VARCHAR) AS job_id, count(*) AS events, CAST(sum(CAST(round(value * 1000000000) AS BIGINT)) AS BIGINT) AS credits_nano, count(*) FILTER (event_type = 'error') AS retries, CASE WHEN count(*) FILTER (event_type = 'error') >= 5 THEN 'retry_explosion' END AS alert FROM events GROUP BY user_id",
    "vectors_exact": "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS c FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0) SELECT query_id, id, c AS cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS INT) AS rank FROM p QUALIFY rank <= 5",
    "stream_credit_windows": up._WITH + "SELECT date_trunc('hour', \"timestamp\") AS start, operation, round(sum(credits_used), 6) AS credits, count(*) AS n FROM e GROUP BY ALL",
    "stream_job_sessions": up._WITH + ", g AS (SELECT *, CASE WHEN \"timestamp\" - lag(\"timestamp\") OVER (PARTITION BY job_id ORDER BY \"timestamp\") < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e), k AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY \"timestamp\" ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT job_id, min(\"timestamp\") AS start, count(*) AS n, round(sum(credits_used), 6) AS credits FROM k GROUP BY job_id, k",
}
