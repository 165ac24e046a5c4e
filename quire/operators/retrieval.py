"""Lexical retrieval: an additive score of titles, aliases, keywords, three BM25 fields and tree context.

A section row has node_id, parent_id, ordinal, type, title, path, raw_content, compressed_content,
micro_summary, aliases, synonyms, keywords, is_front_matter, retrieval_ready. A query is a
literal, so the texts are read once, into a narrow table of flags and term counts; what comes to
the driver is one row of corpus counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.functions import rules as r
from quire.sources.shared import materialized

D = r.SPARK
FIELDS = {"micro_summary": 1.5, "compressed_content": 2.2, "raw_content": 1.5}
NAMES = {"micro_summary": "micro_summary_fts", "compressed_content": "compressed_fts", "raw_content": "raw_fts"}


def query_tokens(query: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)?", query.lower())


def query_entities(query: str) -> list[str]:
    return [tag for tag, p in r.ENTITIES if re.search(p, query.lower())]


def ready(nodes: DataFrame) -> DataFrame:
    return nodes.where("retrieval_ready AND type = 'CONTENT'")


def counted(sections: DataFrame, tokens: list[str], fields: list[str]) -> dict[str, Column]:
    """Columns n_<field>, its number of tokens, and tf_<field>, how often each of tokens is among them: all
    that BM25 needs of a text, so that it is split once."""
    out = {}
    for f in fields:
        words = F.expr(r.query_tokens(D, f))
        out[f"n_{f}"] = F.size(words)
        out[f"tf_{f}"] = F.array(*(F.size(words) - F.size(F.array_remove(words, t)) for t in tokens)) if tokens else F.expr("CAST(array() AS array<int>)")
    return out


def corpus_counts(index: DataFrame, tokens: list[str], fields: list[str]) -> tuple[int, float, dict[str, int]]:
    """Sections, mean length of the joined fields, and in how many of them each token occurs."""
    size = sum((F.col(f"n_{f}") for f in fields), F.lit(0))
    holds = lambda i: F.greatest(*(F.get(f"tf_{f}", F.lit(i)) > 0 for f in fields), F.lit(False))
    row = index.agg(F.count("*"), F.sum(size), *(F.count_if(holds(i)) for i in range(len(tokens)))).first()
    n = max(row[0], 1)
    return n, (row[1] or 0) / n, dict(zip(tokens, row[2:], strict=True))


def bm25(field: str, query: list[str], n: int, avgdl: float, df: dict[str, int]) -> Column:
    """k1 = 1.5, b = 0.75; a token that the query repeats counts each time. df: in the order of tf_<field>."""
    length = 1.5 * (F.lit(0.25) + 0.75 * F.col(f"n_{field}") / max(avgdl, 1.0))
    place = {t: i for i, t in enumerate(df)}
    total = F.lit(0.0)
    for t in query:
        f = F.get(f"tf_{field}", F.lit(place[t]))
        idf = F.ln(F.lit((n - df[t] + 0.5) / (df[t] + 0.5) + 1.0))
        total = total + F.when(f > 0, idf * (f * 2.5) / (f + length)).otherwise(0.0)
    return total


def rank_documents(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """docs: doc_id, text. The k best by BM25: doc_id, score; ties go to the smaller id."""
    tokens = query_tokens(query)
    wanted = list(dict.fromkeys(tokens))
    index = materialized(docs.select("doc_id", "text").select("doc_id", *(c.alias(x) for x, c in counted(docs, wanted, ["text"]).items())), "counted")
    n, avgdl, df = corpus_counts(index, wanted, ["text"])
    return index.select("doc_id", F.round(bm25("text", tokens, n, avgdl, df), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, dl: an inverted index for many queries."""
    t = docs.select("doc_id", F.expr(r.query_tokens(D, "text")).alias("tokens"))
    return t.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


#: Documents and queries that one task scores against each other.
PART_DOCS, BLOCK_QUERIES = 4096, 256


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, dl, terms, tf of texts (doc_id, tokens: hashes): a row a text, each term once."""
    for whole in batches:
        for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            names, code = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            pair, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(names), 1) + code, return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(sizes) + 1) * max(len(names), 1)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), listed(names[pair % max(len(names), 1)]), listed(tf.astype(np.int32))], ["doc_id", "dl", "terms", "tf"])


def _packed_postings(docs: DataFrame) -> DataFrame:
    """doc_id, dl, terms (64-bit hashes), tf: the postings of a document in one row; rows of one id and length are one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.transform(F.expr(r.query_tokens(D, "text")), lambda x: F.xxhash64(x)).alias("tokens"))
    rows = materialized(rows.mapInArrow(_packed, f"doc_id {kind}, dl int, terms array<bigint>, tf array<int>"), "postings")
    again = materialized(rows.groupBy("doc_id", "dl").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "dl"), "repeated")
    if again.isEmpty():
        return rows
    same = rows.alias("x").join(again.alias("y"), F.expr("x.doc_id <=> y.doc_id AND x.dl = y.dl"), "left_semi")
    one = same.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tf")).alias("p")).groupBy("doc_id", "dl", "p.terms").agg(F.sum("p.tf").cast("int").alias("tf"))
    one = one.groupBy("doc_id", "dl").agg(F.collect_list(F.struct("terms", "tf")).alias("p")).select("doc_id", "dl", "p.terms", "p.tf")
    return materialized(rows.alias("x").join(again.alias("y"), F.expr("x.doc_id <=> y.doc_id AND x.dl = y.dl"), "left_anti").unionByName(one), "postings")


def _best(k: int, avgdl: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of the documents (block, part, doc_id, dl, terms, tf) and the terms of queries (block, part, query_id, term, w) of one group:
    the k best documents of each query."""

    def one(docs: pa.Table, terms: pa.Table) -> pa.Table:
        if not docs.num_rows or not terms.num_rows:
            return schema.empty_table()
        docs = docs.take(pc.sort_indices(docs, [("doc_id", "ascending")])).combine_chunks()  # ties go to the smaller id
        ids, asked = terms.column(2).combine_chunks().unique(), pc.index_in(terms.column(2), terms.column(2).combine_chunks().unique()).to_numpy()
        lists, coded = docs.column(4), pc.dictionary_encode(docs.column(2).combine_chunks(), null_encoding="encode")
        own = coded.dictionary  # rows of one id count as one document
        row = np.repeat(np.arange(docs.num_rows), pc.list_value_length(lists).to_numpy())
        at = coded.indices.to_numpy()[row]
        tf, dl = pc.list_flatten(docs.column(5)).to_numpy(), docs.column(3).to_numpy()[row]
        s = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
        by_term = np.argsort(term := pc.list_flatten(lists).to_numpy(), kind="stable")
        at, s, term = at[by_term], s[by_term], term[by_term]
        wanted = np.argsort(names := terms.column(3).to_numpy(), kind="stable")
        names, first = np.unique(names[wanted], return_index=True)
        score = np.zeros((len(ids), len(own)))
        for q, lo, hi in zip(np.split(wanted, first[1:]), np.searchsorted(term, names), np.searchsorted(term, names, "right"), strict=True):
            if hi > lo:
                gain, place = np.outer(terms.column(4).to_numpy()[q], s[lo:hi]), np.ix_(asked[q], at[lo:hi])
                if len(own) == docs.num_rows:
                    score[place] += gain
                else:
                    np.add.at(score, place, gain)
        found = score > 0
        score = np.where(found, np.floor(score * 1e6 + 0.5) / 1e6, -1.0)
        last = min(k, len(own))
        least = np.partition(score, len(own) - last, axis=1)[:, len(own) - last]
        hits = [np.concatenate([more := np.flatnonzero((x > y) & f), np.flatnonzero((x == y) & f)[: last - len(more)]]) for x, y, f in zip(score, least, found, strict=True)]
        of, hits = np.repeat(np.arange(len(ids)), [len(h) for h in hits]), np.concatenate(hits).astype(int)
        return pa.table([ids.take(pa.array(of)), own.take(pa.array(hits)), pa.array(score[of, hits])], schema.names)

    return one


def rank_queries(docs: DataFrame, queries: DataFrame, k: int = 5, part_docs: int = PART_DOCS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """docs: doc_id, text; queries: query_id, query. The k best documents of every query by BM25, exactly: query_id,
    doc_id, score, rank; ties go to the smaller id. Parts of the documents, a row each, meet blocks of the queries' terms,
    and scores are summed up inside a task: what leaves it is k documents of a query, never a row a posting and query."""
    terms = queries.select("query_id", F.explode(F.expr(r.query_tokens(D, "query"))).alias("word")).groupBy("query_id", F.xxhash64("word").alias("term")).agg(F.count("*").alias("times"))
    terms = materialized(terms, "terms")
    index = _packed_postings(docs)
    n = max(docs.count(), 1)
    avgdl = max((index.agg(F.sum(F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0) / n, 1.0)
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    blocks, parts = max(1, -(-terms.select("query_id").distinct().count() // block_queries)), -(-n // part_docs)
    dealt = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    worth = materialized(terms.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("w")), "worth")
    right = worth.select(dealt("query_id", blocks).alias("block_"), every(parts).alias("part_"), "query_id", "term", "w")
    left = index.select(every(blocks).alias("block"), dealt("doc_id", parts).alias("part"), "doc_id", "dl", "terms", "tf")
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    near = left.groupBy("block", "part").cogroup(right.groupBy("block_", "part_")).applyInArrow(_best(k, avgdl, to_arrow_schema(schema)), schema)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k)


def _stops(items: Column, stop, partial) -> tuple[Column, Column, Column]:
    """A loop over items that ends at the first that stops: (has it stopped, partial hits before, last hit)."""
    at = F.array_position(F.transform(items, lambda x: F.coalesce(stop(x), F.lit(False))), True)
    before = F.filter(F.when(at > 0, F.slice(items, 1, (at - 1).cast("int"))).otherwise(items), partial)
    return at > 0, F.size(before), F.when(at > 0, F.get(items, (at - 1).cast("int"))).otherwise(F.get(before, F.size(before) - 1))


def search(nodes: DataFrame, query: str, top_k: int = 5, traversal: bool = True) -> DataFrame:
    """The top_k hits: node_id, title, path, score, match_reason (stages that scored, in order),
    breakdown (their points; a stage that scores twice shows once), matched_title, matched_alias,
    matched_keyword, matched_source, and with traversal parent_title, sibling_titles, child_titles."""
    q, tokens, tags = query.strip().lower(), query_tokens(query.strip()), query_entities(query)
    wanted = list(dict.fromkeys(tokens))
    title, raw = F.lower(F.coalesce("title", F.lit(""))), F.coalesce("raw_content", F.lit(""))
    lowered = lambda c: F.transform(F.coalesce(c, F.expr("CAST(array() AS array<string>)")), F.lower)
    aliases, names, keywords = lowered("aliases"), F.concat(lowered("aliases"), lowered("synonyms")), lowered("keywords")
    no = F.lit(False)
    hints = lambda blob, t: F.greatest(no, no, *(blob.rlike("(?i)" + h) for h in r.TITLE_HINTS[t]))
    steps: list[tuple[str, Column, Column]] = []  # name, condition, points
    if tags:
        steps.append(("front_matter_penalty", F.col("is_front_matter"), F.lit(-100.0)))
        blob = F.lower(F.concat(title, F.lit(" "), F.substring(raw, 1, 500)))
        steps.append(("boilerplate_penalty", title.rlike("test your knowledge|let sum up") & ~F.greatest(no, no, *(hints(blob, t) for t in tags)), F.lit(-120.0)))
    steps.append(("paragraph_title_penalty", F.expr(r.paragraph_title(D, D.strip("coalesce(title, '')"))) & (F.length(title) > 60), F.lit(-150.0)))
    inside = title.contains(q) if len(q) > 4 else no
    steps += [("title_exact", title == q, F.lit(120.0)), ("title_contains_query", (title != q) & inside, F.lit(90.0))]
    for t in dict.fromkeys(tags):
        steps.append((f"entity_title_{t}", hints(F.concat(title, F.lit(" "), F.array_join(aliases, " ")), t), F.lit(200.0 * tags.count(t))))
    exact, loose, alias = _stops(names, lambda a: (a == q) | (a.contains(q) if len(q) > 5 else no), lambda a: a.rlike(r"reg[- ]?0?6") if "reg06" in tags else no)
    steps += [("alias_entity", loose > 0, 95.0 * loose), ("alias_exact", exact, F.lit(85.0))]
    longer = [t for t in tokens if len(t) > 3]
    same, part, keyword = _stops(keywords, lambda k: k.contains(q) | F.lit(q).contains(k), lambda k: F.greatest(no, no, *(k.contains(t) for t in longer)))
    steps += [("keyword_partial", part > 0, 35.0 * part), ("keyword_exact", same, F.lit(70.0))]
    # one pass over the texts: what the later stages need is a narrow table
    snippet = F.replace(F.lower(F.substring(raw, 1, 800)), F.lit("-"), F.lit(""))
    overlap = sum((title.contains(t).cast("int") for t in tokens), F.lit(0))
    kept = {"mentioned": F.greatest(no, no, *(snippet.contains(t) for t in tags)), "overlap": overlap, "alias": alias, "keyword": keyword}
    flags = {f"{x}{i}": c for i, (_, cond, points) in enumerate(steps) for x, c in (("c", F.coalesce(cond, no)), ("p", points.cast("double")))}
    index = ready(nodes).select("node_id", "parent_id", "ordinal", "title", "path", *(c.alias(x) for x, c in {**flags, **kept, **counted(nodes, wanted, list(FIELDS))}.items()))
    index = materialized(index, "counted")
    n, avgdl, df = corpus_counts(index, wanted, list(FIELDS))
    steps = [(name, F.col(f"c{i}"), F.col(f"p{i}")) for i, (name, *_) in enumerate(steps)]
    for f, weight in FIELDS.items():
        points = bm25(f, tokens, n, avgdl, df)
        steps.append((NAMES[f], points > 0, points * weight))
    if traversal:
        index = _near(index, nodes, [t for t in tokens if len(t) > 2])
        steps += [("parent_traversal", F.col("parent_hit"), F.lit(15.0)), ("has_children", F.col("own_ready") > 0, F.lit(5.0)), ("sibling_context", F.col("sibling_hit"), F.lit(8.0))]
    held = [(name, F.coalesce(c, no), p) for name, c, p in steps]
    struct = F.filter(F.array(*(F.when(c, F.struct(F.lit(name).alias("stage"), p.cast("double").alias("points"))) for name, c, p in held)), lambda x: x.isNotNull())
    hit = lambda *starts: F.exists("steps", lambda x: F.greatest(no, no, *(x["stage"].startswith(s) for s in starts)))
    rows = index.withColumn("steps", struct).withColumn("score", F.aggregate("steps", F.lit(0.0), lambda a, x: a + x["points"]))
    kept = rows.where((F.col("score") > 0) | F.col("mentioned"))
    kept = kept.withColumns({"source": F.lit(0), "matched_title": hit("title_", "entity_title_"), "matched_alias": F.when(hit("alias_"), F.col("alias")), "matched_keyword": F.when(hit("keyword_"), F.col("keyword"))})
    content = F.coalesce(*(F.when(hit(NAMES[f]), f) for f in reversed(FIELDS)))
    kept = kept.withColumn("matched_source", content)
    first = kept.agg(F.min_by("score", "ordinal")).first()[0]
    if first is None or first < 30:  # in the order of the document, not of the scores
        extra = rows.where("overlap >= 2").withColumn("score", 20.0 + F.col("overlap") * 5)
        extra = extra.withColumn("steps", F.array(F.struct(F.lit("fallback_lexical").alias("stage"), F.col("score").alias("points"))))
        extra = extra.withColumns({"source": F.lit(1), "matched_title": no, "matched_alias": F.lit(None).cast("string"), "matched_keyword": F.lit(None).cast("string"), "matched_source": F.lit("fallback")})
        both = kept.unionByName(extra.select(*kept.columns))
        best = both.groupBy("node_id").agg(F.max_by(F.struct(*both.columns), F.struct("score", -F.col("source"))).alias("b"))
        kept = best.select("b.*")
    context = ["parent_title", "sibling_titles", "child_titles"] if traversal else []
    top = kept.orderBy(F.desc("score"), "source", "ordinal").limit(top_k)
    if traversal:
        top = _titles(materialized(top, "hits"), nodes).orderBy(F.desc("score"), "source", "ordinal")
    breakdown = F.map_from_entries(F.transform("steps", lambda x: F.struct(x["stage"], F.round(x["points"], 3))))
    return top.select("node_id", "title", "path", F.round("score", 3).alias("score"), F.array_join(F.transform("steps", lambda x: x["stage"]), ",").alias("match_reason"), breakdown.alias("breakdown"), "matched_title", "matched_alias", "matched_keyword", "matched_source", *context)


def _near(index: DataFrame, nodes: DataFrame, tokens: list[str]) -> DataFrame:
    """Adds parent_title, parent_hit, sibling_hit and own_ready (ready children), from one row a parent."""
    no = F.lit(False)
    has = lambda c: F.greatest(no, no, *(F.lower(F.coalesce(c, F.lit(""))).contains(t) for t in tokens))
    of = nodes.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.sum(has(F.col("title")).cast("int")).alias("hits"), F.count_if(F.coalesce("retrieval_ready", no)).alias("n_ready"))
    of = materialized(of, "parents")
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("title").alias("parent_title")).join(of.select("parent_id", "hits"), "parent_id")
    own = of.select(F.col("parent_id").alias("node_id"), F.col("n_ready").alias("own_ready"))
    j = index.join(parents, "parent_id", "left").join(own, "node_id", "left")
    known = F.col("parent_title").isNotNull()
    return j.withColumns({"parent_hit": known & has(F.col("parent_title")), "sibling_hit": known & (F.col("hits") - has(F.col("title")).cast("int") > 0), "own_ready": F.coalesce("own_ready", F.lit(0))}).drop("hits")


def _titles(top: DataFrame, nodes: DataFrame, most: int = 8) -> DataFrame:
    """Adds the titles of ready siblings and children (8 at most) of the few rows of top: of their parents
    the first nine children are looked up, not all."""
    wanted = top.select(F.col("parent_id").alias("parent_id")).unionAll(top.select(F.col("node_id").alias("parent_id"))).where("parent_id IS NOT NULL").distinct()
    ready_kids = nodes.where(F.coalesce("retrieval_ready", F.lit(False))).select("parent_id", "ordinal", "node_id", "title").join(F.broadcast(wanted), "parent_id")  # two rows a hit
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("ordinal", "node_id"))
    first = ready_kids.withColumn("k", rank).where(F.col("k") <= most + 1).groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("k", "node_id", "title"))).alias("kids"))
    first = materialized(first, "kids")
    none = F.expr("CAST(array() AS array<string>)")
    own = first.select(F.col("parent_id").alias("node_id"), F.col("kids").alias("own_kids"))
    j = top.join(first, "parent_id", "left").join(own, "node_id", "left")
    siblings = F.transform(F.slice(F.filter("kids", lambda x: x["node_id"] != F.col("node_id")), 1, most), lambda x: x["title"])
    children = F.transform(F.slice("own_kids", 1, most), lambda x: x["title"])
    return j.withColumns({"sibling_titles": F.when(F.col("parent_title").isNotNull(), F.coalesce(siblings, none)).otherwise(none), "child_titles": F.coalesce(children, none)}).drop("kids", "own_kids")


def harness(nodes: DataFrame, queries: list[tuple[str, list[str]]], top_k: int = 5) -> DataFrame:
    """query, passed: whether a needle stands in title, summary or path of one of the query's hits; a report
    over a list of queries, so it grows with that."""
    nodes = materialized(nodes, "nodes")
    out = None
    for query, needles in queries:
        hits = search(nodes, query, top_k).join(nodes.select("node_id", "micro_summary"), "node_id").select(F.lower(F.concat_ws(" ", "title", "micro_summary", "path")).alias("blob"))
        found = F.greatest(F.lit(False), F.lit(False), *(F.col("blob").contains(n.lower()) for n in needles))
        one = hits.agg(F.coalesce(F.bool_or(found), F.lit(False)).alias("passed")).select(F.lit(query).alias("query"), "passed")
        out = one if out is None else out.unionAll(one)
    return out


def pass_rate(nodes: DataFrame, queries: list[tuple[str, list[str]]], top_k: int = 5) -> float:
    """Share of the queries that harness() passes."""
    return harness(nodes, queries, top_k).agg(F.avg(F.col("passed").cast("int"))).first()[0] if queries else 0.0
