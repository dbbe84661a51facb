"""Outputs that were missing beside registered queries, on rows worked out by hand."""

import datetime as dt

import duckdb
import pytest

from pagelake.operators import reliability as R
from pagelake.operators import stats as A
from pagelake.plans.registry import load_all
from scripts.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a19_points", "a20_run_overall", "a27_task_durations", "j13_able_methods"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q = load_all()[name]
    got = q.build(spark, SF)
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    assert got.columns == cols
    want = [dict(zip(cols, r)) for r in cur.fetchall()]
    assert want and rows_of(got.collect(), cols) == rows_of(want, cols)


def test_able_methods(spark):
    rows = [(1, True, None, False), (2, False, True, True), (3, None, None, None)]
    req = spark.createDataFrame(rows, "id int, needs_javascript boolean, needs_screenshots boolean, needs_cookies boolean")
    got = {(r.id, r.method) for r in R.able_methods(req, spark).collect()}
    assert got == {(1, "pydoll"), (1, "playwright"), (2, "playwright"), (3, "scrapy"), (3, "pydoll"), (3, "playwright")}


def test_overall_row(spark):
    runs = spark.createDataFrame([("a", True, 1.0), ("a", True, 3.0), ("b", False, None), (None, False, 8.0)], "test_type string, passed boolean, response_time double")
    got = {r.test_type: (r.total, r.passed, r.has_passed, r.has_failed, r.min_time, r.mean_time, r.max_time) for r in A.run_report_overall(runs).collect()}
    assert got["overall"] == (4, 2, True, True, 1.0, 4.0, 8.0)
    assert got["a"] == (2, 2, True, False, 1.0, 2.0, 3.0) and got["b"] == (1, 0, False, True, None, None, None)
    assert got[None] == (1, 0, False, True, 8.0, 8.0, 8.0)


def test_task_durations(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("completed", t, t + dt.timedelta(seconds=10)), ("completed", t, t + dt.timedelta(seconds=30)), ("running", t, None)]
    got = {r.status: tuple(r)[1:] for r in A.task_durations(spark.createDataFrame(rows, "status string, started_at timestamp, completed_at timestamp")).collect()}
    assert got == {"completed": (2, 2, 10, 20.0, 30), "running": (1, 0, None, None, None)}
