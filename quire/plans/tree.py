"""Tree queries over region > nation > customer > orders, one document, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.operators import tree

NODES = """
    SELECT 'w' AS node_id, NULL AS parent_id, 'ROOT' AS type, 'World' AS title, 0 AS measure
    UNION ALL SELECT 'r' || r_regionkey, 'w', 'DOCUMENT', r_name, 0 FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 9 = 4 THEN 'APPENDIX' ELSE 'CHAPTER' END, n_name, 0 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 40 = 7 THEN 'FRONT_MATTER' WHEN c_custkey % 11 = 3 THEN 'TOPIC' ELSE 'SECTION' END, c_name, 0 FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'CONTENT', o_orderpriority, CAST(round(o_totalprice) AS BIGINT) FROM orders
"""


def nodes(s: SparkSession, d: str) -> DataFrame:
    t = lambda name: s.read.parquet(f"{d}/{name}.parquet")
    row = lambda i, p, kind, title, m=None: [i.alias("node_id"), p.alias("parent_id"), kind.alias("type"), title.alias("title"), (F.lit(0) if m is None else m).cast("long").alias("measure")]
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    chapter = F.when(F.col("n_nationkey") % 9 == 4, "APPENDIX").otherwise("CHAPTER")
    section = F.when(F.col("c_custkey") % 40 == 7, "FRONT_MATTER").when(F.col("c_custkey") % 11 == 3, "TOPIC").otherwise("SECTION")
    world = s.range(1).select(*row(F.lit("w"), F.lit(None).cast("string"), F.lit("ROOT"), F.lit("World")))
    parts = [
        t("region").select(*row(key("r", "r_regionkey"), F.lit("w"), F.lit("DOCUMENT"), F.col("r_name"))),
        t("nation").select(*row(key("n", "n_nationkey"), key("r", "n_regionkey"), chapter, F.col("n_name"))),
        t("customer").select(*row(key("c", "c_custkey"), key("n", "c_nationkey"), section, F.col("c_name"))),
        t("orders").select(*row(key("o", "o_orderkey"), key("c", "o_custkey"), F.lit("CONTENT"), F.col("o_orderpriority"), F.round("o_totalprice"))),
    ]
    for p in parts:
        world = world.unionByName(p)
    level = F.element_at(F.create_map(*(F.lit(x) for kv in tree.LEVEL.items() for x in kv)), F.col("type"))
    ordinal = level * 100_000_000 + F.coalesce(F.substring("node_id", 2, 20).try_cast("long"), F.lit(0))
    return world.select(F.lit("d").alias("doc_id"), "*", ordinal.alias("ordinal"), F.lit(1).alias("page_start"))


def repeated(s: SparkSession, d: str) -> DataFrame:
    """Customers in order, every second one with the id 'c', and a leaf after each."""
    c = nodes(s, d).where("node_id LIKE 'c%'").withColumn("o", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.substring("node_id", 2, 20).try_cast("long"))))
    c = c.withColumn("node_id", F.when(F.col("o") % 2 == 1, "c").otherwise(F.col("node_id")))
    leaf = c.select("doc_id", F.concat(F.lit("l"), "o").alias("node_id"), F.col("node_id").alias("parent_id"), (F.col("o") * 2 + 1).cast("long").alias("ordinal"))
    return c.select("doc_id", "node_id", "parent_id", (F.col("o") * 2).cast("long").alias("ordinal")).unionByName(leaf)


def deep(s: SparkSession, d: str) -> DataFrame:
    """Parts as chapters in chapters, part p below part p div 2, and their line items as leaves."""
    part, item = (s.read.parquet(f"{d}/{t}.parquet") for t in ("part", "lineitem"))
    item = item.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("l_returnflag"), F.sum(F.round("l_quantity")).alias("l_quantity"))  # an id each
    key = lambda c: F.concat(F.lit("p"), c.cast("string"))
    k = F.col("p_partkey")
    top = s.range(2).select(F.when(F.col("id") == 0, "w").otherwise("d").alias("node_id"), F.when(F.col("id") == 1, "w").alias("parent_id"), F.when(F.col("id") == 0, "ROOT").otherwise("DOCUMENT").alias("type"), F.lit("World").alias("title"), (F.col("id") - 2).alias("ordinal"), F.lit(0).cast("long").alias("measure"))
    chapters = part.select(key(k), F.when(k == 0, "d").otherwise(key(F.floor(k / 2))), F.lit("CHAPTER"), F.col("p_name"), k.cast("long"), F.lit(0).cast("long"))
    number = (F.col("l_orderkey") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey") + 100_000_000
    leaves = item.select(F.concat_ws("_", F.lit("l"), "l_orderkey", "l_partkey", "l_suppkey"), key(F.col("l_partkey")), F.lit("CONTENT"), F.col("l_returnflag"), number, F.round("l_quantity").cast("long"))
    return top.unionAll(chapters).unionAll(leaves).withColumn("doc_id", F.lit("d"))


def looped(s: SparkSession, d: str) -> DataFrame:
    """deep() with part 3 below part 6, which is below part 3; what is not below part 3 is clean."""
    return deep(s, d).withColumn("parent_id", F.when(F.col("node_id") == "p3", "p6").otherwise(F.col("parent_id")))


DEEP = """
    SELECT 'w' AS node_id, NULL AS parent_id, 'ROOT' AS type, 'World' AS title, -2 AS ordinal, 0 AS measure UNION ALL SELECT 'd', 'w', 'DOCUMENT', 'World', -1, 0
    UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_partkey = 0 THEN 'd' ELSE 'p' || (p_partkey // 2) END, 'CHAPTER', p_name, p_partkey, 0 FROM part
    UNION ALL SELECT 'l_' || l_orderkey || '_' || l_partkey || '_' || l_suppkey, 'p' || l_partkey, 'CONTENT', min(l_returnflag), (l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey + 100000000, CAST(sum(round(l_quantity)) AS BIGINT) FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey
"""
_DEEP = f"WITH RECURSIVE n AS ({DEEP})"
_LEVEL = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tree.LEVEL.items()) + " END"
_N = f"WITH RECURSIVE n0 AS ({NODES}), n AS (SELECT 'd' AS doc_id, *, {_LEVEL} * 100000000 + coalesce(try_cast(substring(node_id, 2) AS BIGINT), 0) AS ordinal FROM n0)"
_UP = ", up(node_id, ancestor_id, distance) AS (SELECT node_id, node_id, 0 FROM n UNION ALL SELECT up.node_id, n.parent_id, distance + 1 FROM up JOIN n ON n.node_id = up.ancestor_id WHERE n.parent_id IS NOT NULL)"
_SEG = r.path_segment(r.DUCK, "n.title", "n.type")
_PAIRS_SQL = "(VALUES " + ", ".join(f"('{p}', '{c}')" for p, cs in tree.UNDER.items() for c in cs) + ") v(pt, ct)"
_ORDER = ", k AS (SELECT node_id, parent_id, [node_id] AS key FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.parent_id, list_append(k.key, n.node_id) FROM n JOIN k ON n.parent_id = k.node_id), s AS (SELECT *, CAST(row_number() OVER (ORDER BY key) AS INT) AS seq FROM k)"
_BAD = f", bad AS (SELECT n.*, p.type AS parent_type FROM n JOIN n p ON n.parent_id = p.node_id WHERE (p.type, n.type) NOT IN (SELECT pt, ct FROM {_PAIRS_SQL}))"
_SUMS = " SELECT ancestor_id AS node_id, CAST(sum(CASE WHEN type = 'CONTENT' THEN measure ELSE 0 END) AS BIGINT) AS measure FROM up JOIN n USING (node_id) GROUP BY ancestor_id"
_LOOPED = f"WITH RECURSIVE n0 AS ({DEEP}), n AS (SELECT * REPLACE (CASE node_id WHEN 'p3' THEN 'p6' ELSE parent_id END AS parent_id) FROM n0), ok AS (SELECT node_id FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id FROM n JOIN ok ON n.parent_id = ok.node_id)"

QUERIES = {
    "tree_paths": lambda s, d: tree.paths(nodes(s, d)).select("node_id", "path", "depth"),
    "tree_preorder": lambda s, d: tree.preorder(nodes(s, d)).select("node_id", "seq"),
    "tree_renumber": lambda s, d: tree.renumber(nodes(s, d)).select("old_id", "node_id", "parent_id"),
    "tree_children": lambda s, d: tree.children(nodes(s, d)).select("node_id", F.array_join("children", ",").alias("children")),
    "tree_parent_join": lambda s, d: tree.with_parent(nodes(s, d)).select("node_id", "parent_id", "parent_title", "parent_type"),
    "tree_rollup": lambda s, d: tree.rollup(nodes(s, d), "measure").select("node_id", "measure"),
    "tree_structural_hashes": lambda s, d: tree.structural_hashes(nodes(s, d)).select("node_id", "content_hash"),
    "tree_chapter_groups": lambda s, d: tree.chapter_groups(nodes(s, d), 10_000).select("node_id", "grouped_under"),
    "tree_misplaced": lambda s, d: tree.misplaced(nodes(s, d)).select("node_id", "type", "parent_type"),
    "tree_reparented": lambda s, d: tree.reparented(nodes(s, d)).where("new_parent IS NOT NULL").select("node_id", "new_parent"),
    "tree_relinked": lambda s, d: tree.relinked(repeated(s, d)).select("node_id", "parent_id", "ordinal"),
    "tree_grouped": lambda s, d: tree.grouped(nodes(s, d), 10_000).select("node_id", "parent_id", "type", "title"),
    "tree_nested": lambda s, d: tree.nested(nodes(s, d), ("node_id", "type")),
    "tree_unique_ids": lambda s, d: tree.unique_ids(nodes(s, d).withColumn("node_id", F.when(F.col("type") == "CONTENT", F.concat(F.lit("x"), F.col("measure") % 5000)).otherwise(F.col("node_id")))).select("ordinal", "node_id", "new_id"),
    "tree_orphans": lambda s, d: tree.orphans(nodes(s, d).where("node_id <> 'n3'")).select("node_id", "parent_id"),
    "tree_cycles": lambda s, d: tree.cyclic(looped(s, d)).select("node_id"),
    "tree_deep_paths": lambda s, d: tree.paths(deep(s, d)).select("node_id", "path", "depth"),
    "tree_deep_preorder": lambda s, d: tree.preorder(deep(s, d)).select("node_id", "seq"),
    "tree_deep_nested": lambda s, d: tree.nested(deep(s, d), ("node_id", "measure")),
    "tree_deep_rollup": lambda s, d: tree.rollup(deep(s, d), "measure").select("node_id", "measure"),
    "tree_looped_rollup": lambda s, d: tree.rollup(looped(s, d), "measure").select("node_id", "measure"),
    "tree_cycles_all": lambda s, d: tree.cyclic(nodes(s, d).withColumn("parent_id", F.when(F.col("node_id") == "w", F.lit("n2")).otherwise(F.col("parent_id")))).select("node_id"),
    "tree_front_matter_first": lambda s, d: tree.front_matter_first(nodes(s, d).withColumn("type", F.when(F.col("type") == "FRONT_MATTER", "PREFACE").otherwise(F.col("type")))).select("node_id", "type"),
    "tree_container_summaries": lambda s, d: tree.container_summaries(nodes(s, d)).select("node_id", "micro_summary"),
}
ORACLE_SQL = {
    "tree_paths": _N + f", p AS (SELECT node_id, {_SEG} AS path, 0 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, p.path || ' > ' || {_SEG}, depth + 1 FROM n JOIN p ON n.parent_id = p.node_id) SELECT * FROM p",
    "tree_preorder": _N + _ORDER + " SELECT node_id, seq FROM s",
    "tree_renumber": _N + _ORDER + " SELECT s.node_id AS old_id, printf('%04d', s.seq) AS node_id, CASE WHEN p.seq IS NOT NULL THEN printf('%04d', p.seq) END AS parent_id FROM s LEFT JOIN s p ON s.parent_id = p.node_id",
    "tree_children": _N + " SELECT parent_id AS node_id, string_agg(node_id, ',' ORDER BY ordinal) AS children FROM n WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "tree_parent_join": _N + " SELECT n.node_id, n.parent_id, p.title AS parent_title, p.type AS parent_type FROM n LEFT JOIN n p ON n.parent_id = p.node_id",
    "tree_rollup": _N + _UP + " SELECT ancestor_id AS node_id, CAST(sum(CASE WHEN type = 'CONTENT' THEN measure ELSE 0 END) AS BIGINT) AS measure FROM up JOIN n USING (node_id) GROUP BY ancestor_id",
    "tree_structural_hashes": _N + ", c AS (SELECT parent_id AS node_id, string_agg(node_id, '' ORDER BY node_id) AS ids FROM n GROUP BY parent_id) SELECT n.node_id, sha256(coalesce(ids, '') || title || '1') AS content_hash FROM n LEFT JOIN c USING (node_id) WHERE type <> 'CONTENT'",
    "tree_chapter_groups": _N + _UP + ", l AS (SELECT node_id, row_number() OVER (ORDER BY ordinal) AS leaf FROM n WHERE type = 'CONTENT'), m AS (SELECT ancestor_id AS node_id, max(leaf) AS last FROM up JOIN l USING (node_id) GROUP BY 1) SELECT node_id, CASE WHEN coalesce(last, 0) <= 10000 THEN 'Main Guidance' ELSE 'Appendices' END AS grouped_under FROM n LEFT JOIN m USING (node_id) WHERE type IN ('CHAPTER', 'APPENDIX')",
    "tree_misplaced": _N + _BAD + " SELECT node_id, type, parent_type FROM bad",
    "tree_reparented": _N + _UP + _BAD + f", f AS (SELECT * FROM bad), a AS (SELECT f.node_id, arg_min(up.ancestor_id, distance) AS near FROM f JOIN up USING (node_id) JOIN n p ON p.node_id = up.ancestor_id JOIN {_PAIRS_SQL} ON pt = p.type AND ct = f.type WHERE distance > 0 GROUP BY 1) SELECT f.node_id, coalesce(near, (SELECT arg_min(node_id, ordinal) FROM n WHERE type = 'DOCUMENT')) AS new_parent FROM f LEFT JOIN a USING (node_id)",
    "tree_unique_ids": _N + ", x AS (SELECT ordinal, CASE WHEN type = 'CONTENT' THEN 'x' || (measure % 5000) ELSE node_id END AS node_id FROM n), y AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ordinal) - 2 AS k FROM x) SELECT ordinal, node_id, CASE WHEN k < 0 THEN node_id WHEN k < 26 THEN node_id || '_' || chr(CAST(97 + k AS INT)) ELSE node_id || '_z' || repeat('a', CAST(k - 25 AS INT)) END AS new_id FROM y",
    "tree_relinked": _N + """, c AS (SELECT CASE WHEN o % 2 = 1 THEN 'c' ELSE node_id END AS node_id, parent_id, o FROM (SELECT *, CASE WHEN type IN ('SECTION', 'TOPIC', 'FRONT_MATTER') THEN row_number() OVER (PARTITION BY type IN ('SECTION', 'TOPIC', 'FRONT_MATTER') ORDER BY substring(node_id, 2)::BIGINT) END AS o FROM n WHERE node_id LIKE 'c%')),
        k AS (SELECT *, count(*) FILTER (o % 2 = 1) OVER (ORDER BY o) - 2 AS j FROM c), s AS (SELECT *, CASE WHEN o % 2 = 0 OR j < 0 THEN node_id WHEN j < 26 THEN 'c_' || chr(CAST(97 + j AS INT)) ELSE 'c_z' || repeat('a', CAST(j - 25 AS INT)) END AS id FROM k)
        SELECT id AS node_id, parent_id, o * 2 AS ordinal FROM s UNION ALL SELECT 'l' || o, id, o * 2 + 1 FROM s""",
    "tree_grouped": _N + _UP + ", l AS (SELECT node_id, row_number() OVER (ORDER BY ordinal) AS leaf FROM n WHERE type = 'CONTENT'), m AS (SELECT ancestor_id AS node_id, max(leaf) AS last FROM up JOIN l USING (node_id) GROUP BY 1), g AS (SELECT node_id, ordinal, parent_id, CASE WHEN coalesce(last, 0) <= 10000 THEN 1 ELSE 2 END AS g FROM n LEFT JOIN m USING (node_id) WHERE type IN ('CHAPTER', 'APPENDIX')) SELECT n.node_id, CASE WHEN g IS NULL THEN n.parent_id ELSE 'ch_g' || g || '_' || g END AS parent_id, type, title FROM n LEFT JOIN g USING (node_id) UNION ALL SELECT 'ch_g' || g || '_' || g, arg_min(parent_id, ordinal), 'CHAPTER', CASE g WHEN 1 THEN 'Main Guidance' ELSE 'Appendices' END FROM g GROUP BY g",
    "tree_nested": _N + """, j AS (SELECT node_id, parent_id, ordinal, '{"node_id":"' || node_id || '","type":"' || type || '","nodes":' AS h FROM n),
        e AS (SELECT parent_id, '[' || string_agg(h || '[]}', ',' ORDER BY ordinal) || ']' AS kids FROM j WHERE node_id LIKE 'o%' GROUP BY 1), a AS (SELECT j.parent_id, '[' || string_agg(h || coalesce(kids, '[]') || '}', ',' ORDER BY ordinal) || ']' AS kids FROM j LEFT JOIN e ON e.parent_id = j.node_id WHERE node_id LIKE 'c%' GROUP BY 1), b AS (SELECT j.parent_id, '[' || string_agg(h || coalesce(kids, '[]') || '}', ',' ORDER BY ordinal) || ']' AS kids FROM j LEFT JOIN a ON a.parent_id = j.node_id WHERE node_id LIKE 'n%' GROUP BY 1),
        c AS (SELECT j.parent_id, '[' || string_agg(h || coalesce(kids, '[]') || '}', ',' ORDER BY ordinal) || ']' AS kids FROM j LEFT JOIN b ON b.parent_id = j.node_id WHERE node_id LIKE 'r%' GROUP BY 1) SELECT 'd' AS doc_id, '[' || h || kids || '}]' AS tree FROM j JOIN c ON c.parent_id = j.node_id""",
    "tree_orphans": _N + " SELECT node_id, parent_id FROM n WHERE parent_id = 'n3'",
    # the root hangs under n2, so every chain runs into the loop
    "tree_cycles_all": _N + " SELECT node_id FROM n",
    "tree_cycles": _LOOPED + " SELECT node_id FROM n ANTI JOIN ok USING (node_id)",
    "tree_deep_paths": _DEEP + f", p AS (SELECT node_id, {_SEG} AS path, 0 AS depth FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, p.path || ' > ' || {_SEG}, depth + 1 FROM n JOIN p ON n.parent_id = p.node_id) SELECT * FROM p",
    "tree_deep_preorder": _DEEP + _ORDER + " SELECT node_id, seq FROM s",
    "tree_deep_rollup": _DEEP + _UP + _SUMS,
    "tree_looped_rollup": _LOOPED + ", m AS (SELECT n.* FROM n JOIN ok USING (node_id))" + _UP.replace("FROM n ", "FROM m ").replace("JOIN n ", "JOIN m AS n ") + ", t AS (SELECT ancestor_id AS node_id, sum(measure) AS measure FROM up JOIN m USING (node_id) GROUP BY 1) SELECT n.node_id, CAST(coalesce(t.measure, n.measure) AS BIGINT) AS measure FROM n LEFT JOIN t USING (node_id)",
    # texts in preorder of (ordinal, id), each closing what the next one isn't below
    "tree_deep_nested": _DEEP + """, k AS (SELECT node_id, measure, [(ordinal, node_id)] AS key FROM n WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.measure, list_append(k.key, (n.ordinal, n.node_id)) FROM n JOIN k ON n.parent_id = k.node_id),
        o AS (SELECT *, len(key) AS dep, lead(len(key)) OVER (ORDER BY key) AS nxt FROM k) SELECT 'd' AS doc_id, '[' || string_agg('{"node_id":"' || node_id || '","measure":' || measure || ',"nodes":[' || repeat(']}', CAST(greatest(dep - coalesce(nxt, 1) + 1, 0) AS INT)) || CASE WHEN nxt <= dep THEN ',' ELSE '' END, '' ORDER BY key) || ']' AS tree FROM o""",
    "tree_front_matter_first": _N + ", m AS (SELECT node_id, CASE WHEN type = 'FRONT_MATTER' THEN 'PREFACE' ELSE type END AS type, ordinal FROM n), q AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ordinal) AS k FROM m) SELECT node_id, type FROM q WHERE type <> 'PREFACE' OR k = 1",
    "tree_container_summaries": _N + ", c AS (SELECT parent_id AS node_id, title, row_number() OVER (PARTITION BY parent_id ORDER BY ordinal) AS k FROM n WHERE parent_id IS NOT NULL), t AS (SELECT node_id, string_agg(title, ', ' ORDER BY k) AS titles FROM c WHERE k <= 6 GROUP BY 1) SELECT node_id, CASE WHEN titles IS NULL THEN title || ' (structural section).' ELSE title || ': includes ' || titles || '.' END AS micro_summary FROM n LEFT JOIN t USING (node_id) WHERE type <> 'CONTENT'",
}
