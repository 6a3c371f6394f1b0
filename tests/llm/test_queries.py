"""Plans of the registered queries, and their agreement with their SQL."""

from pathlib import Path

import pytest

from lipika.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_product_joins(spark, name):
    text = queries.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    norm = lambda rows: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    assert norm(df.select(*columns).collect()) == norm(want)
