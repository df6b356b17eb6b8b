"""Registered queries against their SQL on DuckDB, and operators against plain Python."""

import datetime as dt
import glob
import math
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tools.compare import rows_of
from trackline.operators import calendars, covariance, drift, evaluate, execution, returns, universe
from trackline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


#: On the smallest tables the panel is sparse, so that gaps are exercised.
CHOSEN = ["returns_arithmetic_ffill", "returns_log_masked", "schedule_anchored_monthly", "asof_benchmark_weights", "expost_metrics", "turnover_half_l1", "redistribute_sector_inv", "brinson_linked", "return_histogram"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def panel(spark, values):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=t), f"a{k}", None if v is None else float(v)) for t, row in enumerate(values) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "date date, asset string, ret double")


def test_returns_fill_gaps(spark):
    df = panel(spark, [[1], [None], [2]]).withColumnRenamed("ret", "price")
    got = [r.ret for r in returns.arithmetic(df).orderBy("date").collect()]
    assert got[0] is None and got[1:] == [0.0, 1.0]
    assert [r.ret for r in returns.logarithmic(df).orderBy("date").collect()] == [None, None, None]


def test_drift_equals_a_daily_loop(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 0.02, (30, 3))
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=t) for t in range(30)]
    targets = {3: [0.2, 0.3, 0.5], 12: [1 / 3, 1 / 3, 1 / 3]}
    rows = [(days[t], f"a{k}", w) for t, ws in targets.items() for k, w in enumerate(ws)]
    got = {(v.date, v.asset): (v.w_in_force, v.w_close) for v in drift.drift(panel(spark, x.tolist()), spark.createDataFrame(rows, "rebal_date date, asset string, weight double")).collect()}
    w = None
    for t in range(30):
        if w is not None:
            close = w * (1 + x[t])
            close = close / close.sum()
            for k in range(3):
                assert np.allclose(got[days[t], f"a{k}"], (w[k], close[k]))
            w = close
        if t in targets:
            w = np.array(targets[t])


def test_covariances_equal_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(0, 0.01, (40, 5))
    x[:, 4] = 0
    df = panel(spark, x.tolist())
    live = x[:, :4]
    for made, want in ((covariance.rolling(df, []), np.cov(live.T)), (covariance.ledoit_wolf(df), None), (covariance.oas(df), None)):
        got = np.zeros((4, 4))
        for v in made.collect():
            i, j = int(v.i[1]), int(v.j[1])
            got[i, j] = got[j, i] = v.cov
        if want is None:
            s = np.cov(live.T, ddof=0)
            m, n, p = np.trace(s) / 4, 40, 4
            if "rho" in made.columns and made is not None:
                rho = made.first().rho
                assert 0 <= rho <= 1
                want = rho * m * np.eye(p) + (1 - rho) * s
        assert np.allclose(got, want)
    c = live - live.mean(axis=0)
    s = c.T @ c / 40
    b2 = sum(np.linalg.norm(np.outer(v, v) - s) ** 2 for v in c) / 40**2
    d2 = np.linalg.norm(s - np.trace(s) / 4 * np.eye(4)) ** 2
    assert math.isclose(covariance.ledoit_wolf(df).first().rho, min(b2 / d2, 1), rel_tol=1e-9)


def test_ewma_closed_form_equals_the_recursion(spark):
    from trackline.functions import kernels

    r = np.random.default_rng(3)
    x = r.normal(0, 0.01, (25, 3))
    x[15] = [0.01, 0, 0]
    x[20, 1] = 0
    df = panel(spark, x.tolist())
    want = list(kernels.ewma_path(x, 0.9, 10))[-1]
    got = {(v.i, v.j): v.cov for v in covariance.ewma(df, calendars.calendar(df), 0.9, 10).collect()}
    assert all(math.isclose(got[f"a{i}", f"a{j}"], want[i, j], rel_tol=1e-9, abs_tol=1e-15) for i in range(3) for j in range(i, 3))


def test_snap_shift_and_as_of(spark):
    days = [dt.date(2020, 1, d) for d in (2, 3, 6, 7, 8)]
    cal = calendars.calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    ask = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 4, 8, 9)], "date date")
    left = {r.date.day: r.snapped and r.snapped.day for r in calendars.snap(ask, cal).collect()}
    right = {r.date.day: r.snapped.day for r in calendars.snap(ask, cal, "right", fallback=True).collect()}
    assert left == {1: None, 4: 3, 8: 8, 9: 8} and right == {1: 2, 4: 6, 8: 8, 9: 8}
    assert {r.date.day: r.shifted and r.shifted.day for r in calendars.shift(cal, cal, 1).collect()} == {2: 3, 3: 6, 6: 7, 7: 8, 8: None}
    facts = spark.createDataFrame([("x", dt.date(2020, 1, 3), 1), ("x", dt.date(2020, 1, 7), 2), ("y", dt.date(2020, 1, 6), 3)], "k string, eff_date date, v int")
    rows = cal.select("date").crossJoin(facts.select("k").distinct())
    got = {(r.k, r.date.day): r.v for r in calendars.as_of(rows, facts, ["k"]).collect()}
    assert got == {("x", 3): 1, ("x", 6): 1, ("x", 7): 2, ("x", 8): 2, ("y", 6): 3, ("y", 7): 3, ("y", 8): 3}


def test_weights_are_refused_or_scaled(spark):
    w = spark.createDataFrame([("d", "a", 1.0), ("d", "a", 1.0), ("d", "b", 2.0)], "eff_date string, asset string, weight double")
    assert {r.asset: r.weight for r in universe.normalise_weights(w).collect()} == {"a": 0.5, "b": 0.5}
    bad = spark.createDataFrame([("d", "a", -1.0), ("d", "b", 2.0)], "eff_date string, asset string, weight double")
    with pytest.raises(Exception, match="negative"):
        universe.normalise_weights(bad).collect()


def test_shares_never_exceed_the_budget(spark):
    r = random.Random(4)
    rows = [(d, f"a{k}", r.random(), r.uniform(5, 500)) for d in range(20) for k in range(8)]
    df = spark.createDataFrame(rows, "date int, asset string, weight double, price double")
    got = execution.to_shares(df, 10_000.0, reserve=0.05, min_weight=0.1, min_notional=300).toPandas()
    spent = (got["shares"] * got["price"]).groupby(got["date"]).sum()
    assert (spent <= 9500 + 1e-6).all() and np.allclose(got.groupby("date")["cash"].first(), 10_000 - spent)


def test_drawdown_and_moments(spark):
    rows = [(dt.date(2020, 1, k + 1), v, 0.0) for k, v in enumerate([0.1, -0.2, 0.05, 0.3, -0.1])]
    s = spark.createDataFrame(rows, "date date, port_ret double, bench_ret double")
    got = [r.drawdown for r in evaluate.drawdown(s, evaluate.active()).orderBy("date").collect()]
    c = np.cumprod([1.1, 0.8, 1.05, 1.3, 0.9])
    assert np.allclose(got, c / np.maximum.accumulate(c) - 1)
    x = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 10, -4]], "v double")
    r = x.select(*evaluate.moments(x["v"], "v")).first()
    assert math.isclose(r[0], 0.466920, abs_tol=1e-6) and math.isclose(r[1], -0.039214, abs_tol=1e-6)
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_as_of_meets_facts_by_equality_alone(spark):
    """Dates before the first start and null dates go; keys are apart; repeated rows and facts all meet."""
    rows = [(k, None if d is None else f"2020-01-{d:02d}") for k in ("a", "b", None) for d in (1, 5, 5, 9, None)]
    facts = [("a", "2020-01-03", 1), ("a", "2020-01-05", 2), ("a", "2020-01-05", 3), ("b", "2020-01-09", 4)]
    r = spark.createDataFrame(rows, "key string, date string").withColumn("date", F.to_date("date"))
    f = spark.createDataFrame(facts, "key string, eff_date string, v int").withColumn("eff_date", F.to_date("eff_date"))
    for keys in (["key"], []):
        own = f if keys else f.drop("key")
        got = calendars.as_of(r, own, keys)
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
        want = []
        for k, d in rows:
            held = [x for x in facts if d and x[1] <= d and (not keys or x[0] == k)]
            want += [(k, d, x[1], x[2]) for x in held if x[1] == max(h[1] for h in held)]
        assert sorted(((x.key, str(x.date), str(x.eff_date), x.v) for x in got.collect()), key=str) == sorted(want, key=str)
