"""Kernels and grouped operators against invariants and plain Python."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackline.functions import kernels
from trackline.operators import matrix, simulate


def window(seed, n, p):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, p)) @ r.normal(size=(p, p)) * 0.01


@pytest.mark.parametrize(("n", "p"), [(60, 12), (20, 30)])
def test_shrinkage_is_positive_and_keeps_the_trace(n, p):
    x = window(1, n, p)
    for f in (kernels.analytical_nonlinear, kernels.quadratic_inverse, kernels.linear):
        assert np.linalg.eigvalsh(f(x)).min() > 0
    assert np.isclose(np.trace(kernels.quadratic_inverse(x)), np.trace(kernels.sample(x)))


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.1, 10))
def test_scale_and_order(seed, c):
    x = window(seed, 40, 6)
    turn = np.random.default_rng(seed).permutation(6)
    for f in (kernels.sample, kernels.linear, kernels.quadratic_inverse):
        s = f(x)
        assert np.allclose(f(c * x), c * c * s, rtol=1e-6)
        assert np.allclose(f(x[:, turn]), s[np.ix_(turn, turn)], rtol=1e-6, atol=1e-12)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 25))
def test_tracking_minimum_meets_the_optimality_conditions(seed, p):
    r = np.random.default_rng(seed)
    cov = kernels.positive_definite(kernels.sample(window(seed, p + 5, p)))
    b = r.dirichlet(np.ones(p))
    kept = np.sort(r.choice(p, max(2, p // 2), replace=False))
    w = kernels.minimise_tracking(cov, b, kept)
    assert w.min() >= 0 and np.isclose(w.sum(), 1)
    g = (cov[np.ix_(kept, kept)] @ w - (cov @ b)[kept]) / np.trace(cov)
    assert (g - g.min())[w > 1e-9].max() < 1e-8


def test_everything_kept_gives_the_benchmark():
    b = np.array([0.5, 0.3, 0.2])
    assert np.allclose(kernels.minimise_tracking(kernels.sample(window(3, 50, 3)), b, np.arange(3)), b)


def test_repair_of_a_singular_matrix():
    s = kernels.positive_definite(np.ones((3, 3)))
    np.linalg.cholesky(s)


def test_dcc_has_the_volatilities_on_its_diagonal():
    x = window(5, 80, 4)
    s, a, b = kernels.dcc(x)
    assert a + b < 1 and np.linalg.eigvalsh(s).min() > -1e-12
    var = max(x[:, 0].var(ddof=1), 1e-14)
    for v in x[:, 0]:
        var = 0.94 * var + 0.06 * v * v
    assert np.isclose(s[0, 0], var)


def test_garch_finds_its_process():
    r = np.random.default_rng(6)
    v, out = 1.0, []
    for _ in range(3000):
        x = np.sqrt(v) * r.normal()
        out.append(x)
        v = 0.1 + 0.1 * x * x + 0.8 * v
    fit = kernels.fit_volatility("garch", np.array(out))
    assert abs(fit["params"]["alpha"] - 0.1) < 0.05 and abs(fit["params"]["beta"] - 0.8) < 0.1
    assert kernels.fit_volatility("garch", np.zeros(50))["converged"] is False


@pytest.mark.parametrize("kind", kernels.VOLATILITY)
def test_higher_orders_of_zero_weight_are_the_simple_model(kind):
    r = np.random.default_rng(1).normal(size=80)
    names, theta, _ = kernels.volatility_model(kind)
    theta = dict(zip(names, theta, strict=True)) | {"gamma": 0.05}
    wide = kernels.volatility_model(kind, 2, 3)[0]
    more = [theta.get(n.rstrip("1"), 0.0) if n[-1] not in "23" else 0.0 for n in wide]
    simple = kernels.conditional_variance(kind, [theta[n] for n in names], r, 1.0)
    assert np.allclose(simple, kernels.conditional_variance(kind, more, r, 1.0, 2, 3))


def test_garch_orders_against_a_plain_recursion():
    r = np.random.default_rng(2).normal(size=50)
    omega, a, b, g = 0.1, [0.05, 0.1], [0.3, 0.2, 0.1], 0.07
    v = []
    for t in range(50):
        at = lambda path, k: path[k] if k >= 0 else 1.0
        new = omega + g * (t > 0 and r[t - 1] < 0) * r[t - 1] ** 2 + sum(c * at(r**2, t - 1 - k) for k, c in enumerate(a)) + sum(c * at(v, t - 1 - k) for k, c in enumerate(b))
        v.append(new if t else 1.0)
    assert np.allclose(v, kernels.conditional_variance("gjr", [omega, *a, *b, g], r, 1.0, 2, 3))


def test_order_search_takes_the_least_criterion(spark):
    r = np.random.default_rng(3).normal(size=60) * 0.02
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(60)]
    rets = spark.createDataFrame([("x", d, float(c)) for d, c in zip(days, r, strict=True)], "asset string, date date, ret double")
    fits = matrix.volatility_fits(rets, ["garch"], (1, 2), (1, 2))
    all_fits = {(p, q): kernels.fit_volatility("garch", r, p, q) for p in (1, 2) for q in (1, 2)}
    best = matrix.select_model(fits, "aic", ("asset", "model")).first()
    assert (best.p, best.q) == min(all_fits, key=lambda k: (all_fits[k]["aic"], k))
    assert len(all_fits[1, 2]["path"]) == 60 and set(all_fits[1, 2]["params"]) == {"omega", "alpha", "beta1", "beta2"}


@pytest.mark.parametrize("volatility", ["ewma", "garch"])
def test_dcc_steps_continue_the_fit(volatility):
    x = window(7, 60, 3)
    state = kernels.dcc_fit(x[:40], volatility=volatility)
    q, var = state["q"], state["var"]
    e = (x[40] - state["mu"]) / np.sqrt(var)
    after = kernels.dcc_step(state, x[40])
    a, b = state["a"], state["b"]
    assert np.allclose(after["q"], (1 - a - b) * state["mean"] + a * np.outer(e, e) + b * q)
    assert np.allclose(np.diag(kernels.dcc_covariance(after)), after["var"])
    if volatility == "garch":
        k = [0, 1, 2]
        paths = [kernels.conditional_variance("garch", [state["omega"][c], state["alpha"][c], state["beta"][c]], np.append(x[:41, c] - state["mu"][c], 0), x[:40, c].var(ddof=1))[-1] for c in k]
        assert np.allclose(paths, after["var"])


def test_dcc_refits_step_from_each_fit(spark):
    x = window(8, 31, 2)
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(31)]
    rets = spark.createDataFrame([(d, n, float(c)) for d, row in zip(days, x, strict=True) for n, c in zip("ab", row, strict=True)], "date date, asset string, ret double")
    from trackline.operators import calendars

    got = matrix.dcc_refits(rets, calendars.calendar(rets), 4, 20).collect()
    assert len(got) == 11 * 3
    found = {(r.date, r.i, r.j): (r.refit, r.cov) for r in got}
    for refit, start in enumerate((20, 24, 28)):
        state = kernels.dcc_fit(x[start - 20 : start])
        for k in range(start, min(start + 4, 31)):
            s = kernels.dcc_covariance(state)
            assert found[days[k], "a", "b"][0] == refit and np.isclose(found[days[k], "a", "b"][1], s[0, 1])
            state = kernels.dcc_step(state, x[k])


def test_to_do_leaves_out_successes(spark):
    grid = simulate.grid(spark, model=["a", "b"], seed=[1, 2])
    done = spark.createDataFrame([("a", 1, "success"), ("b", 1, "error")], "model string, seed int, status string")
    assert {(r.model, r.seed) for r in simulate.to_do(grid, done, ["model", "seed"]).collect()} == {("a", 2), ("b", 1), ("b", 2)}


def test_exclusion_draws_are_numpys(spark):
    assets = spark.createDataFrame([(f"a{k}",) for k in range(10)], "asset string")
    s = spark.createDataFrame([("s", 0.3, 7)], "scenario string, share double, seed int")
    want = {f"a{k}" for k in np.random.default_rng(7).choice(10, size=3, replace=False)}
    assert {r.asset for r in simulate.exclusion_draws(assets, s).collect()} == want


def test_threshold_rule_waits_for_its_cooldown(spark):
    rows = [("m", dt.date(2020, 1, 1) + dt.timedelta(days=t), 0.01 * (-1) ** t, 0.0) for t in range(40)]
    s = spark.createDataFrame(rows, "model string, date date, port_ret double, bench_ret double")
    got = sorted(r.date for r in matrix.threshold_rebalances(s, ["model"], 0.001, 12, 252, cooldown=5).collect())
    assert got[0] == dt.date(2020, 1, 12) and all((b - a).days == 6 for a, b in zip(got, got[1:], strict=False))


def test_positions_keep_their_value(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=t) for t in range(10)]
    prices = spark.createDataFrame([(d, a, 10.0 + k + 0.1 * t) for t, d in enumerate(days) for k, a in enumerate("xy")], "date date, asset string, price double")
    targets = spark.createDataFrame([("m", days[2], "x", 0.5), ("m", days[2], "y", 0.5), ("m", days[6], "x", 1.0), ("m", days[6], "y", 0.0)], "model string, date date, asset string, weight double")
    got = matrix.positions_backtest(targets, prices, ["model"], 1000.0).orderBy("date").toPandas()
    assert list(got["date"]) == days[2:] and np.isclose(got["nav"][0], 1000) and (got["cash"] >= 0).all()
    assert got["n_trades"].tolist() == [2, 0, 0, 0, 2, 0, 0, 0]
