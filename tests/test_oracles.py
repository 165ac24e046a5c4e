"""Every query that SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quire.operators import tree
from quire.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return round(v, 9) if isinstance(v, float) else v


def table(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert table(df.collect(), columns) == table([dict(zip(names, r, strict=True)) for r in result.fetchall()], columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"index_build", "index_build_library"}))
def test_other_query_gives_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_index_of_the_library_has_every_kind_of_node(spark):
    """Chapters, sections, units and topics, of which each but the root hangs under a known parent that may hold it."""
    rows = QUERIES["index_build_library"](spark, SF).collect()
    kind = {(r.doc_id, r.node_id): r.type for r in rows}
    assert len(kind) == len(rows) and {"ROOT", "DOCUMENT", "CHAPTER", "SECTION", "UNIT", "TOPIC", "CONTENT"} <= set(kind.values())
    for r in rows:
        assert r.type == "ROOT" if r.parent_id is None else r.type in tree.UNDER[kind[r.doc_id, r.parent_id]]
    assert any(r.retrieval_ready for r in rows)
