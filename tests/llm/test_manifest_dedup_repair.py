"""The Merkle manifest, exact duplicates and conversation repair: brute force, DuckDB, edge cases."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import conversations, exact_dedup, merkle
from quire.llm.entry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000
#: Nulls in every column, empty and long texts, ties of an id, a repeated row, equal texts in other case.
ROWS = [
    (1, "Abc é", "en", "a", 5), (1, "Abc é", "en", "a", 5), (1, "another", "en", "a", None), (None, "Abc É", "en", "a", 5), (None, None, None, None, None),
    (3, "", "de", "b", 0), (4, "aBC é", "de", None, 5), (5, LONG, "en", "b", 300_000), (6, LONG.upper(), None, "b", 300_000), (7, LONG + "x", "", "b", 300_001),
    (8, " ", "fr", "c", 1), (-9, "abc É", "en", "c", 2**63 - 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["hash", "g", "part", "at", "path", "forged", "size", "head", "mark", "bits", "digest", "n", "r", "kept", "survives", "DIGEST", "TEXT_", "row"]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH if c != "DIGEST"})


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(level, i, fanout):
    """Root of a level's nodes, and the siblings of node i on the way."""
    siblings = []
    while len(level) > 1:
        lo = i // fanout * fanout
        run = level[lo : lo + fanout]
        siblings += [(run[: i - lo], run[i - lo + 1 :])]
        level, i = [H(*level[j : j + fanout]) for j in range(0, len(level), fanout)], i // fanout
    return level[0], siblings


def fold(x, siblings):
    for before, after in siblings:
        x = H(*before, x, *after)
    return x


def slow_manifest(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is None, r[0] or 0, leaf(*r), r))
    groups = {k: sorted(v, key=lambda x: x[:3]) for k, v in sorted(groups.items(), key=lambda kv: (kv[0] is not None, (kv[0] or "").encode()))}
    roots = [climb([x[2] for x in v], 0, fanout)[0] for v in groups.values()]
    out = []
    for k, v in enumerate(groups.values()):
        for i, (*_, own, r) in enumerate(v):
            subroot, low = climb([x[2] for x in v], i, fanout)
            root, high = climb(roots, k, fanout)
            bad = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 0 and r[4] is not None
            top = fold(leaf(*r[:4], r[4] + 1) if bad else own, low + high)
            out.append((r[0], own, subroot, root, H(*(d for b, a in low + high for d in b + a)), top, top == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize(("fanout", "part_rows", "block"), [(2, 50_000, 64), (2, 1, 2), (3, 2, 2), (5, 3, 3)])
def test_manifest_edges(spark, fanout, part_rows, block):
    got = merkle.verify(merkle.manifest(docs(spark), fanout, part_rows, block)).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, slow_manifest(ROWS, fanout)))


def test_manifest_of_many_partitions_and_its_records(spark):
    rows = [(i * 7 % 400, f"t{i}", random.Random(i).choice(["en", "en", "de", None]), "s", i) for i in range(400)]
    m = merkle.manifest(docs(spark, rows), 3, 13, 2)
    got = merkle.verify(m).select(*COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, slow_manifest(rows, 3)))
    # every node above the leaves is recorded once, at its place
    want = set()
    for lang in ("en", "de", None):
        level = [leaf(*r) for r in sorted(r for r in rows if r[2] == lang)]
        n, k = len(level), 0
        while n > 1:
            level, k = [H(*level[j : j + 3]) for j in range(0, n, 3)], k + 1
            n = len(level)
            want |= {("" if lang is None else "=" + lang, k, i, h) for i, h in enumerate(level)}
    nodes = [tuple(r) for r in m.forest.nodes.collect()]
    assert set(nodes) == want and len(nodes) == len(want)


def test_manifest_empty_and_bounds(spark):
    m = merkle.manifest(docs(spark, []))
    assert m.root is None and merkle.verify(m).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(docs(spark), fanout=1)


def low(text):
    return re.sub("[A-Z]", lambda x: x[0].lower(), text or "")


@pytest.mark.parametrize("prefix", [1, 256])
def test_exact_duplicates_edges(spark, prefix):
    groups = defaultdict(list)
    for r in ROWS:
        groups[low(r[1])].append(r[0])
    for digest_all in (False, True):
        got = exact_dedup.exact_duplicates(docs(spark), prefix, digest_all).collect()
        assert len(got) == len(ROWS)
        want = []
        for text, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
        assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got) == sorted(str(w[:3]) for w in want)
        if digest_all:
            assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.digest)) for r in got) == sorted(map(str, want))
        else:  # length or prefix tell these apart: their texts are not hashed
            assert all((r.digest is None) <= (r.group_size == 1) for r in got) and any(r.digest is None for r in got)
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_duplicates_one_of_each_keeps_rows(spark):
    out = exact_dedup.one_of_each(docs(spark))
    assert out.columns == docs(spark).columns
    rows = out.collect()
    assert sorted(low(r.text) for r in rows) == sorted({low(r[1]) for r in ROWS})
    assert exact_dedup.one_of_each(docs(spark, [])).count() == 0
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


def test_a_full_bitmap_only_costs_hashes(spark, monkeypatch):
    """Where more keys survive than the bitmap tells apart, the groups are the same."""
    rows = [(i, f"text {i // 2 if i < 200 else i}", "en", "s", 1) for i in range(400)]
    monkeypatch.setattr(exact_dedup, "MARKS", 8)
    got = exact_dedup.exact_duplicates(docs(spark, rows)).collect()
    assert all(r.digest is not None for r in got)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: (i | 1, 2) if i < 200 else (i, 1) for i in range(400)}


def slow_repair(rows, damage):
    """Every conversation by itself, from the first turn on, over (cost, letters, turns) of each state."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20 if damage else 9
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        talks[conv] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    turned = {0: 2, 1: 2, 2: 3, 3: 2}
    for conv, talk in talks.items():
        talk.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        known, seen, faults = {t for t, *_ in talk if t is not None}, set(), []
        for _, role, text in talk:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        reached = {0: (0, "", [])}

        def put(where, state, option):
            if state not in where or option[:2] < where[state][:2]:
                where[state] = option

        def insertions(where):
            for _ in range(3):
                for state, (cost, letters, turns) in list(where.items()):
                    put(where, turned[state], (cost + 3, letters + "I", [*turns, ("user:" if turned[state] == 2 else "assistant:")]))
            return where

        for (_, role, text), fault in zip(talk, faults, strict=True):
            after, cut = {}, 3 * (fault == "t")
            for state, (cost, letters, turns) in insertions(reached).items():
                put(after, state, (cost + 4, letters + "D", turns))
                if fault not in ("b", "d"):
                    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, role[:1]))
                    if kept:
                        put(after, kept, (cost + cut, letters + "K", [*turns, f"{role}:{text}"]))
                    who = "user" if turned[state] == 2 else "assistant"
                    put(after, turned[state], (cost + 3 + cut, letters + "R", [*turns, f"{who}:{text}"]))
            reached = after
        cost, letters, turns = min((v for k, v in insertions(reached).items() if k in (0, 3)), key=lambda v: v[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


def repaired(spark, rows, damage, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ["piece", "start", "mark", "tie", "at", "audit", "cost"]})
    df = conversations.damaged(df) if damage else df
    got = conversations.repair(df, **how).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:9] for r in got}


def random_turns(seed, n, convs):
    rnd = random.Random(seed)
    texts = ["a.", "b", "c!", " \t\n", None, "", "d.\r\n", "e?", "é. x", "…"]
    return [(rnd.choice(convs), rnd.choice([None, *range(5 * n)]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ua"]), rnd.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"piece_turns": 1, "parts": 5}, {"piece_turns": 3, "parts": 2}])
@pytest.mark.parametrize("damage", [False, True])
def test_repair_random(spark, how, damage):
    rows = random_turns(7, 300, [None, 1, 2, 3, *range(4, 40)])
    rows += rows[:40]  # repeated rows
    assert repaired(spark, rows, damage, **how) == slow_repair(rows, damage)


@pytest.mark.parametrize("how", [{}, {"piece_turns": 64, "parts": 4}])
def test_repair_one_long_conversation(spark, how):
    """Nearly all rows are of one conversation: it is cut into pieces and joined again."""
    rows = random_turns(11, 1200, [5]) + random_turns(12, 30, [4, 6])
    assert repaired(spark, rows, True, **how) == slow_repair(rows, True)


def test_repair_defined_cases(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", LONG + "."), (2, None, None, None), (3, 0, "assistant", "Yes."), (4, 0, "system", "Be."), (4, 0, "system", "Be.")]
    got = repaired(spark, rows, False)
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert got[2] == (0, 1, 0, 0, 0, 4, "D", nothing)
    assert got[3][:7] == (0, 0, 0, 0, 0, 3, "IK")
    assert got[4] == (0, 0, 1, 0, 1, 8, "DD", nothing)
    assert repaired(spark, rows[:0], True) == {}
    turns = conversations.repair(spark.createDataFrame(rows[3:4], "conv_id long, turn long, role string, text string"), with_turns=True).first()
    assert [tuple(t) for t in turns.repaired] == [("user", ""), ("assistant", "Yes.")]


def test_repair_conversation_whose_turns_are_gone(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(1, dropped, "user", "Hi.")], True) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup", "op13_conversation_repair"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
