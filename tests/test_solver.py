"""Solves that start from earlier weights: the same optimum in fewer rounds."""

import datetime

import numpy as np
import pytest

from trackline.functions import kernels
from trackline.operators import matrix


def problem(seed, n=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(3 * n, n)) @ (np.eye(n) + 0.3 * rng.normal(size=(n, n)))
    return np.cov(x.T), rng.dirichlet(np.ones(n)), np.sort(rng.choice(n, 25, replace=False))


@pytest.mark.parametrize("seed", range(6))
def test_any_start_ends_at_the_optimum(seed):
    cov, bench, kept = problem(seed)
    cold, rounds = kernels.solve_tracking(cov, bench, kept)
    rng = np.random.default_rng(seed)
    for start in (rng.random(40), np.where(rng.random(40) < 0.8, 0, rng.random(40)), np.zeros(40), np.eye(40)[kept[3]]):
        warm, _ = kernels.solve_tracking(cov, bench, kept, start=start)
        assert np.abs(warm - cold).max() < 1e-7
    full = np.zeros(40)
    full[kept] = cold
    again, few = kernels.solve_tracking(cov, bench, kept, start=full)
    assert few <= 2 <= rounds and np.abs(again - cold).max() < 1e-9
    # Optimality: the gradient is level where weights are held, and not lower elsewhere.
    g = (cov @ (full - bench))[kept]
    held = cold > 1e-9
    assert np.ptp(g[held]) < 1e-8 * np.trace(cov) and (g[~held] >= g[held].min() - 1e-8 * np.trace(cov)).all()


def test_the_ridge_pulls_towards_the_start():
    cov, bench, kept = problem(9)
    start = np.random.default_rng(0).random(40)
    own = start[kept] / start[kept].sum()
    far = [np.abs(kernels.solve_tracking(cov, bench, kept, start=start, ridge=r)[0] - own).sum() for r in (0.0, 0.1, 1.0, 10.0, 1e6)]
    assert far == sorted(far, reverse=True) and far[-1] < 1e-4 < far[0]


@pytest.mark.parametrize("run", [3, 100])
def test_ordered_solves_take_fewer_rounds(spark, run):
    rng = np.random.default_rng(3)
    names = [f"a{k:02d}" for k in range(30)]
    dates = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(10)]
    x = rng.normal(size=(90, 30)) @ (np.eye(30) + 0.3 * rng.normal(size=(30, 30)))
    cov, bench = [], []
    base = rng.dirichlet(np.ones(30))
    for k, d in enumerate(dates):
        s = np.cov(x[k : k + 80].T)
        cov += [("m", d, names[i], names[j], float(s[i, j])) for i in range(30) for j in range(i, 30)]
        w = base * (1 + 0.01 * rng.random(30))
        bench += [(d, a, float(v)) for a, v in zip(names, w / w.sum())]
    cov = spark.createDataFrame(cov, "model string, rebal_date date, i string, j string, cov double")
    bench = spark.createDataFrame(bench, "rebal_date date, asset string, weight double")
    out = spark.createDataFrame([(a,) for a in names[::3]], "asset string")
    alone = {(r.rebal_date, r.asset): r.weight for r in matrix.tracking_minimal(cov, bench, out).collect()}
    got = {warm: matrix.tracking_minimal_ordered(cov, bench, out, run, warm=warm).collect() for warm in (True, False)}
    for rows in got.values():
        assert {(r.rebal_date, r.asset): r.weight for r in rows} == pytest.approx(alone, abs=1e-7)
    total = {warm: sum(r.rounds for r in rows if r.asset == "a00") for warm, rows in got.items()}
    assert total[True] < total[False]
    near, free = (matrix.tracking_minimal_ordered(cov, bench, out, 100, ridge=r).toPandas().pivot(index="rebal_date", columns="asset", values="weight").diff().abs().sum().sum() for r in (1e6, 0.0))
    assert near < 1e-4 < free
