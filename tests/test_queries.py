"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from marginalia.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else x
    return tuple(map(plain, x)) if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    answer = duck.execute(registry.SQL[name])
    at = [d[0] for d in answer.description]
    assert sorted(at) == names
    want = sorted(repr(tuple(plain(r[at.index(c)]) for c in names)) for r in answer.fetchall())
    assert got == want


# Columns l_returnflag, l_linestatus, l_linenumber and l_tax of row i.
EDGES = {
    "weak edges": ("i % 2, CASE WHEN i = 0 THEN 1 ELSE i // 2 % 2 END, i // 4 % 7, (CASE WHEN i % 3 = 0 THEN i // 4 % 7 ELSE i // 28 % 9 END) / 100", 10080),
    "constant columns": ("0, 0, 0, 0", 16),
    "one constant column": ("i % 2, i // 2 % 2, i // 4 % 3, 0", 12),
    "a round of edges": ("i % 4, i // 2 % 4, i // 4 % 4, i // 8 % 2 + i % 2 * 2", 16),
    "many cells": ("i % 20, i % 20, i % 20, i % 20", 400),
    "a tie in rounding": ("CASE WHEN i < 1024 THEN 1 ELSE 0 END, CASE WHEN i % 1024 < (CASE WHEN i < 1024 THEN 513 ELSE 511 END) THEN 1 ELSE 0 END, 0, 0", 2048),
    "nulls": ("nullif(i % 3, 1), nullif(i // 2 % 3, 0), nullif(i % 5, 2), NULL", 300),
    "two zeros": ("i % 2, CASE WHEN i IN (0, 4, 8) THEN 1 ELSE i // 2 % 2 END, i // 4 % 50, CASE WHEN i // 200 % 2 = 0 THEN -(0::DOUBLE) ELSE 0 END", 10000),
    "no rows": ("0, 0, 0, 0", 0),
}


@pytest.mark.parametrize("case", EDGES)
def test_graph_edges(spark, tmp_path, case):
    texts, rows = EDGES[case]
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CAST(a AS VARCHAR) AS l_returnflag, CAST(b AS VARCHAR) AS l_linestatus, CAST(c AS INTEGER) AS l_linenumber, CAST(d AS DOUBLE) AS l_tax
                          FROM (SELECT {texts} FROM range({rows}) r(i)) AS t(a, b, c, d)) TO '{tmp_path}/lineitem.parquet'""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = registry.QUERIES["graph_edges"](spark, str(tmp_path)).select("src", "dst", "tvd").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.SQL["graph_edges"]).fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["attr_a", "attr_b", "tvd"] and df.count() == 4
