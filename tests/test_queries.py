"""Every registered query on the smallest tables: against its SQL, or that it runs."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import cell

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, data, db, name):
    df = QUERIES[name](spark, data)
    order = sorted(df.columns)
    got = Counter(tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in order]).collect())
    if name in SQL:
        rel = db.sql(SQL[name])
        assert sorted(rel.columns) == order
        assert got == Counter(tuple(map(cell, r)) for r in rel.select(*[f'"{c}"' for c in order]).fetchall())
    else:
        assert got


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["label", "level", "clan_acc", "n_total", "n_families", "top_families", "confidence"]
