"""Studies over models against a walk over days in plain Python: windows, weights, drift, metrics and calibration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackline.functions import kernels
from trackline.plans import grouped
from trackline.plans.relational import ANN, Panel

DIR = "/root/testdata/sf0.001"
LENGTH = 36


def simplex(v):
    """The nearest point that has no negative part and sum one."""
    u = np.sort(v)[::-1]
    k = np.arange(1, len(v) + 1)
    excess = (np.cumsum(u) - 1) / k
    return np.maximum(v - excess[np.flatnonzero(u > excess)[-1]], 0)


def least_tracking(s, bench, kept, rounds=20_000):
    """Projected gradient steps with momentum; another way than the library's active sets."""
    a, q = s[np.ix_(kept, kept)], (s @ bench)[kept]
    step = 1 / np.linalg.eigvalsh(a)[-1]
    w = y = np.full(len(kept), 1 / len(kept))
    t = 1.0
    for _ in range(rounds):
        new = simplex(y - step * (a @ y - q))
        if (new - w) @ (y - new) < 0 or t > 1e9:
            later = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, w, t = new + (t - 1) / later * (new - w), new, later
        else:
            # The momentum points uphill: start it anew.
            y, w, t = new, new, 1.0
    out = np.zeros(len(bench))
    out[kept] = w
    return out


@pytest.fixture(scope="module")
def study(spark):
    """Everything behind the queries by hand, from returns, dates and benchmark weights."""
    p = Panel(spark, DIR)
    rets = p.rets.toPandas().pivot(index="date", columns="asset", values="ret").sort_index().fillna(0.0)
    names, dates, x = list(rets.columns), list(rets.index), rets.to_numpy(float)
    cal = [r.date for r in p.cal.orderBy("idx").collect()]
    start = {d: np.array([g.set_index("asset")["weight"].get(a, 0.0) for a in names]) for d, g in p.quarter_starts.toPandas().groupby("rebal_date")}
    caps = p.bars.groupBy("asset").agg(F.sum("revenue").alias("cap")).toPandas()
    ranked = [a for _, a in sorted(zip(caps["cap"], caps["asset"], strict=True))]
    small = set(ranked[: math.ceil(len(ranked) * 0.2)])
    row = {d: k for k, d in enumerate(dates)}
    covs, targets, ante = {}, {}, {}
    for d, b in sorted(start.items()):
        end = cal.index(d)
        if end < LENGTH - 1:
            continue
        window = np.array([x[row[c]] if c in row else np.zeros(len(names)) for c in cal[end - LENGTH + 1 : end + 1]])
        for m in grouped.MODELS:
            s = np.cov(window.T) if m == "rolling" else kernels.on_active(window, kernels.ESTIMATORS[m])
            covs[m, d] = s
            kept = np.array([k for k, a in enumerate(names) if a not in small and b[k] > 0 and s[k, k] > 1e-12])
            w = least_tracking(s, b / b.sum(), kept)
            targets[m, d] = w
            ante[m, d] = (w - b / b.sum()) @ s @ (w - b / b.sum())

    def walk(goals):
        """Returns by date: holdings grow, and are reset behind the close of a date that has goals."""
        held, out = None, {}
        for d in dates:
            if held is not None:
                grown = held * (1 + x[row[d]])
                out[d] = grown.sum() / held.sum() - 1
                held = grown
            if d in goals:
                held = goals[d].copy()
        return out

    bench = walk(start)
    series = {}
    for m in grouped.MODELS:
        port = walk({d: w for (k, d), w in targets.items() if k == m})
        series[m] = [(d, port[d], bench[d]) for d in sorted(set(port) & set(bench))]
    return {"covs": covs, "targets": targets, "ante": ante, "series": series, "names": names}


def close(got, want, far=2e-5):
    return got == pytest.approx(want, rel=far, abs=far) if want is not None else got is None


def test_weights_of_least_tracking(spark, study):
    rows = grouped.te_min_qp(spark, DIR).collect()
    got = {}
    for r in rows:
        got.setdefault((r.model, r.rebal_date), {})[r.asset] = r.weight
    assert len(study["targets"]) > 8 and {(m, str(d)) for m, d in study["targets"]} == set(got)
    for (m, d), w in study["targets"].items():
        own = got[m, str(d)]
        assert np.abs(np.array([own.get(a, 0.0) for a in study["names"]]) - w).max() < 1e-4, (m, d)


def test_metrics_of_backtests(spark, study):
    rows = {r.model: r for r in grouped.backtest_te_min(spark, DIR).collect()}
    assert set(rows) == set(grouped.MODELS)
    for m, s in study["series"].items():
        port, bench = np.array([r[1] for r in s]), np.array([r[2] for r in s])
        active, r = port - bench, rows[m]
        sd = active.std(ddof=1)
        want = {"te_daily": sd, "te_ann": sd * ANN**0.5, "active_mean_ann": active.mean() * ANN, "mse": (active**2).mean(), "mae": np.abs(active).mean(), "bench_cum": np.prod(1 + bench), "port_cum": np.prod(1 + port), "rel_cum": np.prod(1 + port) / np.prod(1 + bench) - 1}
        assert r.n == len(s) and all(close(r[k], v) for k, v in want.items()), (m, r, want)


def test_years_of_backtests(spark, study):
    rows = {(r.model, r.year): r for r in grouped.backtest_yearly(spark, DIR).collect()}
    wanted = 0
    for m, s in study["series"].items():
        for year in {0} | {d.year for d, _, _ in s}:
            own = [r for r in s if year in (0, r[0].year)]
            port, bench = np.array([r[1] for r in own]), np.array([r[2] for r in own])
            r, change = rows[m, year], np.prod(1 + port) - np.prod(1 + bench)
            te = (port - bench).std(ddof=1) * ANN**0.5 if len(own) > 1 else None
            span = (own[-1][0] - own[0][0]).days / 365.25
            assert r.n == len(own) and close(r.active_return, change) and close(r.te, te) and close(r.active_return_ann, change / span if span else None), (m, year)
            assert close(r.ir, change / te if te else None, 1e-3), (m, year)
            wanted += 1
    assert len(rows) == wanted > 8


def test_calibration_of_backtests(spark, study):
    """The query takes the weights' tracking variance at each rebalance against that of active returns up to the next."""
    rows = {r.model: r for r in grouped.backtest_calibration(spark, DIR).collect()}
    for m, s in study["series"].items():
        at = sorted(d for k, d in study["targets"] if k == m)
        ratios, gaps = [], []
        for k, d in enumerate(at):
            active = np.array([p - b for c, p, b in s if c >= d and (k + 1 == len(at) or c < at[k + 1])])
            if not len(active):
                continue
            post = active.var(ddof=1) if len(active) >= 5 else (np.prod(1 + active) - 1) ** 2 / len(active)
            gaps.append(study["ante"][m, d] - post)
            if post:
                ratios.append(study["ante"][m, d] / post)
        r = rows[m]
        assert r.n == len(ratios) and r.mean_ratio == pytest.approx(np.mean(ratios), rel=1e-2, abs=1e-3) and r.std_ratio == pytest.approx(np.std(ratios, ddof=1), rel=1e-2, abs=1e-3)
        assert close(r.below, np.mean([v < 1 for v in ratios]), 1e-4) and close(r.above, np.mean([v > 1 for v in ratios]), 1e-4) and close(r.bias_ann, np.mean(gaps) * ANN, 1e-4)


def test_losses_of_models(spark, study):
    rows = {(r.model, r.rebal_date): r.frobenius for r in grouped.covariance_losses(spark, DIR).collect()}
    want = {(m, str(d)): np.linalg.norm(s - study["covs"]["rolling", d]) for (m, d), s in study["covs"].items() if m != "rolling"}
    assert set(rows) == set(want) and all(rows[k] == pytest.approx(v, abs=2e-8) for k, v in want.items())
