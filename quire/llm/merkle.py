"""Merkle manifest of a table: a tree a language, a tree over their roots, a proof a document.

Leaves are sorted into partitions by range; a partition is indexed, so the place of its first leaf in its
language is known. A task runs a mountain range over its leaves: a stack with one run of fewer than
``fanout`` nodes a level, where a full run is hashed and carried up, as a digit is in base fanout. Runs
that began in another partition are unaligned at the left, the last ones are open at the right: both
leave the task as peaks, a few a level. Peaks of ``block`` neighbouring partitions are merged by the same
stack, then those of block merged ones, until one range is left, whose open runs are hashed as they are
(no padding). On the way back down each peak learns its siblings up to the root, so a second look
at a partition gives every leaf its proof. Texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import crc32_sql, id_order, parallelism, written

#: Every document whose checksum this divides is tampered with in a verification.
TAMPERED = 7
#: Leaves of a partition at most, nearly.
PART_ROWS = 50_000
#: Leaves of a partition, where there are fewer.
LEAST_ROWS = 1000
#: Neighbouring ranges that one task merges.
BLOCK = 64
#: Bits of a row's place below its partition's number.
PLACE = 33

_PATH = "array<struct<before:string,after:string>>"
_RECORD = f"kind string, part long, g string, n long, start long, level int, idx long, hash string, to_level int, to_idx long, path {_PATH}"
_ARROW_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_ARROW = pa.schema(
    [("kind", pa.string()), ("part", pa.int64()), ("g", pa.string()), ("n", pa.int64()), ("start", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("to_level", pa.int32()), ("to_idx", pa.int64()), ("path", _ARROW_PATH)]
)


def joined_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Range:
    """A mountain range: consecutive nodes go in from the left, whole subtrees are hashed as soon as they are full."""

    def __init__(self, fanout: int):
        self.fanout = fanout
        self.runs: dict[int, list[tuple[int, str]]] = {}  # by level: open runs, from their first node on
        self.edge: list[tuple[int, int, str]] = []  # nodes whose run began further left
        self.made: list[tuple[int, int, str]] = []
        self.siblings: dict[tuple[int, int], tuple[str, str]] = {}

    def push(self, level: int, idx: int, digest: str) -> None:
        run = self.runs.setdefault(level, [])
        if not run and idx % self.fanout:
            self.edge.append((level, idx, digest))
            return
        run.append((idx, digest))
        if len(run) == self.fanout:
            self._carry(level)

    def _carry(self, level: int) -> None:
        run = self.runs.pop(level)
        digests = [d for _, d in run]
        for i, (idx, _) in enumerate(run):
            self.siblings[level, idx] = ("".join(digests[:i]), "".join(digests[i + 1 :]))
        up = (level + 1, run[0][0] // self.fanout, joined_hash(digests))
        self.made.append(up)
        self.push(*up)

    def finish(self, n: int) -> tuple[int, str]:
        """Level and hash of the root of n leaves, all of which have gone in."""
        level = 0
        while n > 1:
            if self.runs.get(level):
                self._carry(level)
            n, level = -(-n // self.fanout), level + 1
        return level, self.runs[level][0][1]

    def peaks(self) -> list[tuple[int, int, str]]:
        return self.edge + [(level, idx, d) for level, run in self.runs.items() for idx, d in run]

    def climb(self, level: int, idx: int) -> tuple[int, int, list[tuple[str, str]]]:
        """The highest node above this one that the range knows, and the siblings on the way."""
        steps = []
        while (level, idx) in self.siblings:
            steps.append(self.siblings[level, idx])
            level, idx = level + 1, idx // self.fanout
        return level, idx, steps


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    if rows:
        columns[-1] = [None if p is None else [{"before": a, "after": b} for a, b in p] for p in columns[-1]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _runs_of(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    """The groups of a partition's leaves, each in order."""
    table = table.sort_by("at")
    names = table.column("g").to_pylist()
    lo = 0
    for hi in range(1, len(names) + 1):
        if hi == len(names) or names[hi] != names[lo]:
            yield names[lo], table.slice(lo, hi - lo)
            lo = hi


def _filled(fanout: int, start: int, n: int, digests: list[str]) -> tuple[Range, tuple[int, str] | None]:
    """The range of a group's leaves in one partition, and the group's root if all its leaves are here."""
    here = Range(fanout)
    for i, d in enumerate(digests, start):
        here.push(0, i, d)
    return here, here.finish(n) if len(digests) == n else None


def _grown(fanout: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def one(leaves: pa.Table, places: pa.Table) -> pa.Table:
        known = {r["g"]: r for r in places.to_pylist()}
        out = []
        for g, rows in _runs_of(leaves):
            p = known[g]
            here, root = _filled(fanout, p["start"], p["n"], rows.column("hash").to_pylist())
            found = [("node", *x) for x in here.made] + ([("root", root[0], 0, root[1])] if root else [("peak", *x) for x in here.peaks()])
            out += [(kind, p["part"], g, p["n"], p["start"], level, idx, d, None, None, None) for kind, level, idx, d in found]
        return _table(out)

    return one


def _merged(fanout: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def one(peaks: pa.Table) -> pa.Table:
        rows = sorted(peaks.to_pylist(), key=lambda r: r["idx"] * fanout ** r["level"])
        g, n, bin_ = rows[0]["g"], rows[0]["n"], rows[0]["bin"]
        here = Range(fanout)
        for r in rows:
            here.push(r["level"], r["idx"], r["hash"])
        if last:
            level, digest = here.finish(n)
            left = [("root", level, 0, digest)]
        else:
            left = [("peak", *x) for x in here.peaks()]
        out = [(kind, bin_, g, n, None, level, idx, d, None, None, None) for kind, level, idx, d in left + [("node", *x) for x in here.made]]
        for r in rows:
            level, idx, steps = here.climb(r["level"], r["idx"])
            out.append(("path", bin_, g, n, None, r["level"], r["idx"], None, level, idx, steps))
        return _table(out)

    return one


@dataclass
class Forest:
    """Trees over groups of leaves: leaves (g, hash, at, part and what they carry), nodes (g, level, idx, hash; leaves
    left out), roots (g, n, level, hash), edges: of each partition and group the peaks, with start, n and the
    siblings from the peak to the group's root."""

    fanout: int
    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    edges: DataFrame


def grow(items: DataFrame, order: list[Column], fanout: int = 2, part_rows: int = PART_ROWS, block: int = BLOCK) -> Forest:
    """items: g (group, not null), hash (hexadecimal) and whatever a leaf carries; the leaves of a group are
    sorted by order, rows that agree in it must have equal hashes. An empty table has no trees."""
    if fanout < 2 or block < 2:
        raise ValueError("fanout and block are 2 at least")
    spark = items.sparkSession
    rows = items.count()
    parts = max(1, -(-rows // part_rows), min(parallelism(spark), rows // LEAST_ROWS))
    order = [F.col("g"), *order, F.col("tie")]  # equal rows may lie in two partitions
    ranged = items.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    leaves = written(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", PLACE)), "merkle-leaves")
    parts = 1 + (leaves.agg(F.max("part")).first()[0] or 0)

    of_group = Window.partitionBy("g")
    counts = leaves.groupBy("part", "g").agg(F.count("*").alias("c"))
    places = counts.select("part", "g", (F.sum("c").over(of_group.orderBy("part")) - F.col("c")).alias("start"), F.sum("c").over(of_group).alias("n"))
    first = written(leaves.select("part", "g", "at", "hash").groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_grown(fanout), _RECORD), "merkle-grown")

    rounds, width = [first], 1
    while width < parts:
        width *= block
        peaks = rounds[-1].where("kind = 'peak'").withColumn("bin", F.floor(F.col("part") / block))
        rounds.append(written(peaks.groupBy("g", "bin").applyInArrow(_merged(fanout, width >= parts), _RECORD), "merkle-merged"))

    pick = lambda kind: _union([r.where(F.col("kind") == kind) for r in rounds])
    roots = pick("root").select("g", "n", "level", "hash")
    above = None
    for r in reversed(rounds[1:]):
        paths = r.where("kind = 'path'").select("g", "level", "idx", "to_level", "to_idx", "path")
        if above is not None:
            higher = above.select("g", F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.col("path").alias("rest"))
            paths = paths.join(higher, ["g", "to_level", "to_idx"]).withColumn("path", F.concat("path", "rest"))
        above = paths.select("g", "level", "idx", "path")
    columns = ["part", "g", "start", "n", "level", "idx", "path"]
    edges = first.where("kind = 'root'").withColumn("path", F.expr(f"CAST(array() AS {_PATH})")).select(*columns)
    if above is not None:
        edges = edges.unionByName(first.where("kind = 'peak'").drop("path").join(above, ["g", "level", "idx"]).select(*columns))
    return Forest(fanout, leaves, pick("node").select("g", "level", "idx", "hash"), roots, edges)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def climbed(forest: Forest, edges: DataFrame, seen: Callable[[dict, list[tuple[str, str]], dict], tuple], fields: pa.Schema, ddl: str) -> DataFrame:
    """seen(leaf, siblings up to the root, edge) of every leaf, a row of the given fields each. edges: those of
    the forest, whose paths may have been made longer and which may carry more columns."""
    fanout = forest.fanout

    def one(leaves: pa.Table, here: pa.Table) -> pa.Table:
        known: dict[str, dict] = {}
        for e in here.to_pylist():
            known.setdefault(e["g"], {})[e["level"], e["idx"]] = (e, [(s["before"], s["after"]) for s in e["path"]])
        out = []
        for g, rows in _runs_of(leaves):
            tops = known[g]
            any_edge = next(iter(tops.values()))[0]
            grown, _ = _filled(fanout, any_edge["start"], any_edge["n"], rows.column("hash").to_pylist())
            for i, leaf in enumerate(rows.to_pylist(), any_edge["start"]):
                level, idx, steps = grown.climb(0, i)
                edge, rest = tops[level, idx]
                out.append(seen(leaf, steps + rest, edge))
        columns = zip(*out, strict=True) if out else [[] for _ in fields]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return forest.leaves.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(one, ddl)


def _field(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


@dataclass
class Manifest:
    """forest: the trees of the languages (g: '' for a null language, else '=' and the language); top: the tree over
    their roots; root: the hash of all, None for an empty table."""

    forest: Forest
    top: Forest
    root: str | None


def manifest(docs: DataFrame, fanout: int = 2, part_rows: int = PART_ROWS, block: int = BLOCK) -> Manifest:
    """Of docs (doc_id, source, lang, n_chars, text), each row a leaf of its language's tree.

    A null in any column is hashed as '-'. The leaves of a language ascend by doc_id, null ids last, rows
    of one id by their hash; repeated rows are leaves each. Long texts are hashed whole, in the scan. An empty table has no
    root; other columns, whatever their names, are neither hashed nor carried.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = F.sha2(F.concat(*map(_field, fields)), 256)
    wrong = F.struct("doc_id", "source", "lang", (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars"), "text").alias("w")
    forged = F.sha2(F.concat(*(_field(f"w.{c}") for c in fields)), 256)
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPERED == 0
    g = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    hashed = docs.select(*fields).select("*", wrong).select(F.col("doc_id").cast("long").alias("doc_id"), g.alias("g"), leaf.alias("hash"), F.when(hit, forged).alias("forged"))
    forest = grow(written(hashed, "merkle-hashed"), [id_order(), F.col("hash")], fanout, part_rows, block)
    roots = forest.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "hash")
    top = grow(written(roots, "merkle-roots"), [F.col("name")], fanout, part_rows, block)
    found = top.roots.first()
    return Manifest(forest, top, found and found["hash"])


def proofs(m: Manifest, seen: Callable[[dict, list[tuple[str, str]], dict], tuple], fields: pa.Schema, ddl: str) -> DataFrame:
    """seen(leaf, siblings from the leaf up to the manifest's root, edge) of every document: the leaf has doc_id, hash
    and forged, siblings are pairs (hashes before, hashes after) a level, the edge has subroot."""
    path = pa.schema([("g", pa.string()), ("subroot", pa.string()), ("rest", _ARROW_PATH)])
    to_root = climbed(m.top, m.top.edges, lambda leaf, steps, _: (leaf["name"], leaf["hash"], [{"before": a, "after": b} for a, b in steps]), path, f"g string, subroot string, rest {_PATH}")
    edges = m.forest.edges.join(written(to_root, "merkle-top"), "g").withColumn("path", F.concat("path", "rest")).drop("rest")
    return climbed(m.forest, edges, seen, fields, ddl)


def folded(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf's hash and its siblings give."""
    for before, after in steps:
        digest = joined_hash([before, digest, after])
    return digest


def verify(m: Manifest) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 (of all siblings on the way to the root),
    folded_root (from the leaf, or from the tampered one of each document whose id's checksum TAMPERED divides; a null
    id's is that of the empty text), verified (whether that is the root)."""
    root = m.root

    def seen(leaf: dict, steps: list[tuple[str, str]], edge: dict) -> tuple:
        top = folded(leaf["forged"] or leaf["hash"], steps)
        return leaf["doc_id"], leaf["hash"], edge["subroot"], root, joined_hash([x for s in steps for x in s]), top, top == root

    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    fields = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names), ("verified", pa.bool_())])
    return proofs(m, seen, fields, "doc_id long, " + ", ".join(f"{c} string" for c in names) + ", verified boolean")


_F = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_SQL_LEAF = " || ".join(_F.format(c) for c in ("doc_id", "source", "lang", "{0}", "text"))

ORACLE = f"""
    WITH RECURSIVE leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_SQL_LEAF.format('n_chars')}) AS leaf,
            CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN sha256({_SQL_LEAF.format('(n_chars + 1)')}) END AS forged,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    lv AS (SELECT g, 0 AS k, i, leaf AS h, n FROM leaf UNION ALL SELECT g, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY g, k, i // 2, n),
    sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
    tp AS (SELECT 'top' AS g, 0 AS k, i, subroot AS h, n FROM sub UNION ALL SELECT g, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tp WHERE n > 1 GROUP BY g, k, i // 2, n),
    node AS (SELECT g, k, i, h FROM lv UNION ALL SELECT g, k, i, h FROM tp),
    up AS (SELECT doc_id, l.g, 0 AS k, l.i, l.n, sub.i AS si, sub.n AS sn, coalesce(forged, leaf) AS x, '' AS proof FROM leaf l JOIN sub USING (g)
        UNION ALL SELECT doc_id, CASE WHEN u.n = 1 THEN 'top' ELSE u.g END, CASE WHEN u.n = 1 THEN 0 ELSE u.k + 1 END, CASE WHEN u.n = 1 THEN si ELSE u.i // 2 END, CASE WHEN u.n = 1 THEN sn ELSE (u.n + 1) // 2 END, si, sn,
            CASE WHEN u.n = 1 THEN x WHEN u.i % 2 = 0 THEN sha256(x || coalesce(s.h, '')) ELSE sha256(s.h || x) END, CASE WHEN u.n = 1 THEN proof ELSE proof || coalesce(s.h, '') END
        FROM up u LEFT JOIN node s ON s.g = u.g AND s.k = u.k AND s.i = xor(u.i, 1) AND u.n > 1 WHERE NOT (u.g = 'top' AND u.n = 1)),
    r AS (SELECT h AS root FROM tp WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified
    FROM up JOIN leaf USING (doc_id) JOIN sub ON sub.g = leaf.g CROSS JOIN r WHERE up.g = 'top' AND up.n = 1"""
