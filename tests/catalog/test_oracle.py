"""Every registered catalog query against its SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from filmroll.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA

SF = str(DATA / "sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def rows(columns, data):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return (0, "")
        return (1, f"{round(float(x), 5):.5f}") if isinstance(x, (int, float)) and not isinstance(x, bool) else (2, str(x))

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    got = found.collect()
    if name not in ORACLE_SQL:
        return
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, got) == rows(names, want.fetchall())
