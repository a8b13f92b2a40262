"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"aap_newton", "peel_down_one_gen", "peel_up_one_gen"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: "" if v is None else repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n not in SLOW)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    rel = duck.execute(entry.oracle_sql()[name])
    want = canon(rel.fetchall(), [c[0] for c in rel.description])
    assert sorted(df.columns) == sorted(c[0] for c in rel.description)
    assert got == want


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
