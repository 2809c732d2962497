import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from momentlake.plans import oracles, queries, training_checks

DATA = "/root/testdata/sf0.001"
CORE = queries.QUERIES | training_checks.QUERIES
SQL = oracles.SQL | training_checks.SQL


def shown(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return "None" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, DATA)
    got = df.collect()
    if name in SQL:
        want = duck.execute(SQL[name])
        assert sorted(df.columns) == sorted(d[0] for d in want.description)
        assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_llm_imports_it():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "momentlake")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "momentlake.llm" not in text.read(), f
