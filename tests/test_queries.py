"""Every query of the engine against its SQL, on the smallest tables."""

import importlib.util
import math
from collections import Counter

import duckdb
import pytest

from pairloom import plans


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def table(rows, cols):
    return Counter(tuple(cell(r[c]) for c in sorted(cols)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, small, duck, name):
    df = plans.QUERIES[name](spark, small)
    r = duck.execute(plans.ORACLES[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert table((x.asDict() for x in df.collect()), cols) == table((dict(zip(cols, x, strict=True)) for x in r.fetchall()), cols)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and set(plans.QUERIES) <= set(q)
    if importlib.util.find_spec("pairloom.llm") and importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in q and sum(n.startswith("op") for n in q) == 10
