"""Every registered query against its SQL on the smallest tables that give it rows."""

import math

import duckdb
import pytest

from quillon.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that need more rows: users with five visits, items with enough reviews to survive pruning.
LARGER = dict.fromkeys(("prepare_dataset", "user_location"), "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def ducks():
    found = {}
    for sf in (SF, *LARGER.values()):
        found[sf] = duckdb.connect()
        for t in TABLES:
            found[sf].execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, ducks, name):
    sf = LARGER.get(name, SF)
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name not in ORACLES:
        return
    cursor = ducks[sf].execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in got), key=str) == want
