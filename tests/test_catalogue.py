"""Every registered query against its SQL on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from quillgrain.plans import catalogue


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    return x.isoformat()[:19] if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert rows and len(set(df.columns)) == len(df.columns)
        return
    rel = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)


def test_plans_push_down(spark, data):
    """Only the columns that a query needs are read, and filters reach the scan."""
    plan = catalogue.QUERIES["q_script_char_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "IsNotNull(text)" in plan and "Exchange" not in plan
