"""Every registered query against its DuckDB oracle on the small tables."""

import math
import os

import duckdb
import pytest

from basalt.plans import registry

SF = os.environ.get("BASALT_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def clean(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def ordered(rows):
    return sorted((tuple(map(clean, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    rows = registry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = [tuple(r) for r in rows.select(*[f"`{c}`" for c in columns]).collect()]
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    a, b = ordered(got), ordered(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=0.011)) for p, q in zip(x, y)), (x, y)


def test_all_queries_have_oracles():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
