"""Every query that has SQL gives what the SQL gives."""

from __future__ import annotations

from difflib import SequenceMatcher

import duckdb
import pytest

from lumenry.plans import catalog, reads, rules  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(str(round(float(v), 6)) if type(v).__name__ in ("float", "Decimal") else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in catalog.SQL:
        assert rows
        if name == "similarity_ratio":  # the ratio of the standard library, of each row
            told = {r.p_partkey: (r.p_name.lower(), f"{r.p_type} {r.p_name}".lower()) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
            assert all(r.ratio == SequenceMatcher(None, *told[r.p_partkey]).ratio() for r in df.collect())
        return
    got = duck.execute(catalog.SQL[name])
    told = [d[0] for d in got.description]
    assert sorted(told) == columns
    order = [told.index(c) for c in columns]
    assert plain(rows) == plain(tuple(r[k] for k in order) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
