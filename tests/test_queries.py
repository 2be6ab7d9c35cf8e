"""Every query with SQL against DuckDB on the smallest data; every other one must give rows."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
Q = {k: v for m in entry._modules() if not m.__name__.endswith("llm.queries") for k, v in m.QUERIES.items()}
S = {k: v for m in entry._modules() if not m.__name__.endswith("llm.queries") for k, v in m.SQL.items()}


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else str(int(v)) if v == int(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(S))
def test_against_sql(spark, con, name):
    df = Q[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(S[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted("|".join(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted("|".join(plain(x[c]) for c in cols) for x in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_gives_rows(spark, name):
    assert Q[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans(spark):
    """Filters and columns reach the scan; cuts to k are limited inside the window; no row-wise Python function anywhere."""
    plan = Q["exclude_types"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,document_type:string>" in plan
    plan = Q["pending_documents"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(processing_status,pending)" in plan
    plan = Q["hybrid_citations"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    plan = Q["row_cap"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
