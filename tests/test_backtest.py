"""Backtests against a plain loop over days and assets, scenario by scenario."""

import datetime
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackline.operators import backtest, calendars, matrix
from trackline.operators.backtest import Settings, Shares

ANN = 52
DATES = [datetime.date(2021, 1, 4) + datetime.timedelta(days=7 * k) for k in range(70)]
NAMES = ["B", "A", "C", "D"]


@pytest.fixture(scope="module")
def world():
    """Prices with gaps, benchmark returns, targets of two kinds of scenarios, flows."""
    r = random.Random(7)
    price, ret = {}, {}
    for a in NAMES:
        level = r.uniform(5, 50)
        for k, d in enumerate(DATES):
            step = r.gauss(0.001, 0.03)
            level *= 1 + step
            price[d, a] = None if r.random() < 0.05 and k else level
            ret[d, a] = None if r.random() < 0.08 else step
    bench = {d: (0.0 if k == 0 else r.gauss(0.001, 0.02)) for k, d in enumerate(DATES)}
    scenarios = {"calendar": None, "rule": (0.15, 12, 5), "both": (0.2, 15, 0), "idle": None, "never": (9.0, 12, 0)}
    targets, calendar = {}, {}
    for s in scenarios:
        for k, d in enumerate(DATES):
            if s != "idle" and k > 8 and r.random() < 0.9:
                raw = [r.choice([0, r.random()]) for _ in NAMES]
                if sum(raw) > 0:
                    targets[s, d] = {a: w / sum(raw) for a, w in zip(NAMES, raw)}
        calendar[s] = [d for k, d in enumerate(DATES) if s in ("calendar", "both", "idle") and k % 9 == 4]
    flows = {DATES[20]: 0.25, DATES[40]: -0.1}
    return price, ret, bench, scenarios, targets, calendar, flows


def drifted(w, r):
    g = {a: w[a] * (1 + r[a]) for a in w}
    total = sum(g.values())
    return {a: v / total for a, v in g.items()} if total > 0 else w


def by_value(shares, p):
    total = sum(shares[a] * p[a] for a in shares)
    return {a: shares[a] * p[a] / total if total > 1e-12 else 0.0 for a in shares}


def buy(book, w, p, value):
    w = {a: 0.0 if abs(x) < book.min_weight else x for a, x in w.items()}
    budget = (1 - book.reserve) * value
    if sum(w.values()) <= 1e-12:
        return dict.fromkeys(w, 0.0)
    money = {a: x / sum(w.values()) * budget for a, x in w.items()}
    if book.min_position > 0:
        money = {a: 0.0 if m < book.min_position else m for a, m in money.items()}
        if sum(money.values()) <= 1e-12:
            return dict.fromkeys(w, 0.0)
        scale = budget / sum(money.values())
        money = {a: m * scale for a, m in money.items()}
    rounded = round if book.rounding == "round" else math.floor
    return {a: (m / p[a] if book.fractional else rounded(m / p[a] / book.lot) * book.lot) if p[a] > 0 else 0.0 for a, m in money.items()}


def plain(world, name, s):
    price, ret, bench, scenarios, targets, calendar, flows = world
    rule, book = scenarios[name], s.shares
    filled, seen = [], {}
    for d in DATES:
        seen |= {a: price[d, a] for a in NAMES if price[d, a] is not None}
        filled.append(dict(seen))
    w = {"A": 0.5, "B": 0.25, "C": 0.25, "D": 0.0}
    nav, cash, waiting, last, out, active = s.start, 0.0, {}, None, [], [0.0]
    shares = None
    if book:
        shares = buy(book, w, filled[0], nav)
        cash = nav - sum(shares[a] * filled[0][a] for a in NAMES)
        w = by_value(shares, filled[0])
    out.append((0.0, nav, cash, 0.0, 0, None, False, w))
    for i, d in enumerate(DATES[1:], 1):
        r = {a: ret[d, a] or 0.0 for a in NAMES}
        cost, n, traded = 0.0, 0, i in waiting
        if book:
            p0, p = filled[i - 1], filled[i]
            before = sum(shares[a] * p0[a] for a in NAMES) + cash
            cash *= 1 + book.cash_return
            nav = sum(shares[a] * p[a] for a in NAMES) + cash
            got = nav / before - 1
            cash, nav = cash + flows.get(d, 0), nav + flows.get(d, 0)
            w = by_value(shares, p)
            active.append(got - bench[d])
            if traded:
                goal = waiting.pop(i)
                cost = s.bps / 1e4 * sum(abs(goal[a] - w[a]) for a in NAMES) + s.fixed
                cash, nav = cash - cost * nav, nav - cost * nav
                want = buy(book, goal, p, nav)
                change = {a: want[a] - shares[a] for a in NAMES}
                change = {a: c if abs(c) * p[a] >= book.min_trade else 0.0 for a, c in change.items()}
                if cash - sum(change[a] * p[a] for a in NAMES) < -1e-6:
                    there = cash + sum(-c * p[a] for a, c in change.items() if c < 0)
                    need = sum(c * p[a] for a, c in change.items() if c > 0)
                    k = min(1, there / need) if there > 0 and need > 1e-12 else 0
                    change = {a: math.floor(c * k) if c > 0 else c for a, c in change.items()}
                shares = {a: shares[a] + change[a] for a in NAMES}
                cash -= sum(change[a] * p[a] for a in NAMES)
                n, w = sum(c != 0 for c in change.values()), by_value(shares, p)
        else:
            w = waiting.pop(i, w)
            got = sum(w[a] * r[a] for a in NAMES)
            nav = nav * (1 + got) + flows.get(d, 0)
            w = drifted(w, r)
            active.append(got - bench[d])
        why = "calendar" if d in calendar[name] else None
        if why is None and rule and i > 1 and i + 1 >= rule[1] and not (rule[2] and last is not None and i - last < rule[2]):
            own = active[i - rule[1] + 1 : i + 1]
            if len(own) >= max(10, rule[1] // 3) and statistics.stdev(own) * math.sqrt(ANN) > rule[0]:
                why, last = "rule", i
        goal = targets.get((name, d))
        if why and goal:
            if s.charge and not book:
                cost = s.bps / 1e4 * sum(abs(goal[a] - w[a]) for a in NAMES) + s.fixed
                nav, got = nav * (1 - cost), got - cost
                active[i] = got - bench[d]
            waiting[i + s.apply_lag] = goal
        out.append((got, nav, cash, cost, n, why if goal else None, traded, w))
    return out


@pytest.mark.parametrize("settings", [
    Settings(), Settings(apply_lag=3, bps=25, fixed=0.0004, charge=True),
    Settings(start=10_000.0, bps=10, shares=Shares(reserve=0.02, min_weight=0.02, min_position=300, min_trade=50, lot=2, cash_return=0.0005)),
    Settings(start=500.0, bps=30, apply_lag=2, shares=Shares(rounding="round")), Settings(start=100.0, shares=Shares(fractional=True)),
], ids=["weights", "charged", "lots", "rounded", "fractional"])
@pytest.mark.parametrize("buckets", [1, 3])
def test_every_scenario_equals_the_plain_loop(spark, world, settings, buckets):
    price, ret, bench, scenarios, targets, calendar, flows = world
    panel = spark.createDataFrame([(d, a, ret[d, a], price[d, a]) for d in DATES for a in NAMES], "date date, asset string, ret double, price double").repartition(5)
    out = backtest.run(
        panel, spark.createDataFrame(list(bench.items()), "date date, bench_ret double"), spark.createDataFrame([("A", 0.5), ("B", 0.25), ("C", 0.25)], "asset string, weight double"),
        spark.createDataFrame([(s, d, a, w) for (s, d), own in targets.items() for a, w in own.items() if w], "scenario string, date date, asset string, weight double"),
        spark.createDataFrame([(s, d) for s, ds in calendar.items() for d in ds], "scenario string, date date"),
        spark.createDataFrame([(s, *(r or (None, None, None))) for s, r in scenarios.items()], "scenario string, threshold double, window int, cooldown int"),
        ANN, settings, spark.createDataFrame(list(flows.items()), "date date, flow double"), buckets,
    )
    got = {}
    for r in out.collect():
        got.setdefault(r.scenario, {})[r.date] = r
    assert set(got) == set(scenarios)
    for name in scenarios:
        want = plain(world, name, settings)
        for d, (earned, nav, cash, cost, n, why, traded, w) in zip(DATES, want, strict=True):
            r = got[name][d]
            assert (r.n_trades, r.decided, r.traded) == (n, why, traded), (name, d)
            assert [r.port_ret, r.nav, r.cash, r.cost, r.bench_ret] == pytest.approx([earned, nav, cash, cost, bench[d]], rel=1e-9, abs=1e-9), (name, d)
            assert r.close == pytest.approx(w, abs=1e-9)
    decided = {n: sum(r.decided is not None for r in got[n].values()) for n in scenarios}
    assert decided["rule"] > 1
    assert decided["idle"] == 0 and decided["never"] == 0 and decided["calendar"] > 3 and decided["both"] >= decided["calendar"] - 2
    cut = {(r.scenario, r.date): r.nav for r in backtest.from_first_decision(out).collect()}
    first = min(d for d, r in got["calendar"].items() if r.decided)
    assert cut["calendar", first] == 1 and ("calendar", DATES[0]) not in cut and cut["idle", DATES[0]] == settings.start
    assert backtest.weights(out).filter("scenario = 'idle'").count() == len(DATES) * len(NAMES)


def test_orders_wait_a_day_at_least(spark, world):
    with pytest.raises(ValueError, match="a day after"):
        backtest.run(None, None, None, None, None, None, ANN, Settings(apply_lag=0))


def test_candidates_look_back_by_their_lags(spark):
    """Another return after the data's last date, or benchmark weights after theirs, change nothing."""
    rng = np.random.default_rng(1)
    rows = [(d, a, float(rng.normal(0, 0.02))) for d in DATES for a in NAMES]
    returns = spark.createDataFrame(rows, "date date, asset string, ret double")
    cal = calendars.calendar(returns)
    comp = spark.createDataFrame([(d, a, 0.25 + 0.05 * k) for d in DATES for k, a in enumerate(NAMES)], "date date, asset string, weight double")
    at = spark.createDataFrame([(DATES[40],)], "rebal_date date")
    resets = spark.createDataFrame([(DATES[10],), (DATES[30],)], "date date")
    out = spark.createDataFrame([("D",)], "asset string")

    def solve(r):
        path = backtest.benchmark_path(r, comp, resets)
        found = backtest.candidates(r, cal, path, at, ["rolling"], 20, 2, 2, out).collect()
        return {x.asset: x.weight for x in found}

    base = solve(returns)
    later = solve(returns.withColumn("ret", F.when(F.col("date") > DATES[38], 0.5).otherwise(F.col("ret"))))
    assert base == pytest.approx(later) and base["D"] == 0 and sum(base.values()) == pytest.approx(1)
    assert solve(returns.withColumn("ret", F.when((F.col("date") == DATES[38]) & (F.col("asset") == "A"), 0.5).otherwise(F.col("ret")))) != pytest.approx(base)


@pytest.mark.parametrize("together", [1, 2, 100])
def test_scenarios_share_covariances_and_keep_their_weights(spark, together):
    """Each scenario's weights are those of a solve for itself; one leaves out all, one nothing."""
    rng = np.random.default_rng(6)
    names = list("abcde")
    cov, bench = [], []
    for d in DATES[:3]:
        s = np.cov(rng.normal(size=(30, 5)).T)
        cov += [("m", d, names[i], names[j], float(s[i, j])) for i in range(5) for j in range(i, 5)] + [("n", d, names[i], names[j], float(2 * s[i, j] * (i == j))) for i in range(5) for j in range(i, 5)]
        bench += [(d, a, float(w)) for a, w in zip(names, rng.dirichlet(np.ones(5)))]
    left = {"none": [], "two": ["a", "d"], "all": names, "odd": ["zz", "b"]}
    cov = spark.createDataFrame(cov, "model string, rebal_date date, i string, j string, cov double")
    bench = spark.createDataFrame(bench, "rebal_date date, asset string, weight double")
    out = spark.createDataFrame([(s, a) for s, own in left.items() for a in own], "scenario string, asset string")
    got = matrix.tracking_minimal_scenarios(cov, bench, out, spark.createDataFrame([(s,) for s in left], "scenario string"), together).collect()
    assert len(got) == 4 * 3 * 2 * 5
    found = {(r.model, r.scenario, r.rebal_date, r.asset): r for r in got}
    for s, own in left.items():
        alone = matrix.tracking_minimal(cov, bench, spark.createDataFrame([(a,) for a in own], "asset string")).collect()
        for r in alone:
            f = found[r.model, s, r.rebal_date, r.asset]
            assert (f.weight, f.te_ante, f.n_kept) == (pytest.approx(r.weight, abs=1e-12), pytest.approx(r.te_ante, abs=1e-12), r.n_kept)


def test_evaluation_of_models_is_the_sum_of_its_parts(spark):
    rng = np.random.default_rng(2)
    returns = spark.createDataFrame([(d, a, float(rng.normal(0.001, 0.02))) for d in DATES for a in NAMES], "date date, asset string, ret double")
    comp = spark.createDataFrame([(d, a, 0.1 * (k + 1)) for d in DATES for k, a in enumerate(NAMES)], "date date, asset string, weight double")
    at = spark.createDataFrame([(DATES[k],) for k in (10, 25, 40, 55)], "rebal_date date")
    out = spark.createDataFrame([("C",)], "asset string")
    got = backtest.full_evaluation(returns, comp, at, spark.createDataFrame([(DATES[30],)], "date date"), ["rolling", "lw"], 20, ANN, excluded=out)
    days = got["days"].toPandas()
    for name, own in days.groupby("scenario"):
        own = own.sort_values("date")
        # The first date with a history of 20 returns up to the day before.
        assert own["date"].iloc[0] == DATES[25] and own["nav"].iloc[0] == 1
        assert list(own["date"][own["traded"]]) == [DATES[26], DATES[41], DATES[56]]
        assert all(c["C"] == 0 for c in own["close"])
        te = (own["port_ret"] - own["bench_ret"]).std(ddof=1) * math.sqrt(ANN)
        assert {r.scenario: r.te_ann for r in got["economic"].collect()}[name] == pytest.approx(te)
    assert {r.scenario for r in got["summary"].collect()} == {"rolling", "lw"} == {r.model for r in got["targets"].select("model").distinct().collect()}
    assert got["yearly"].count() > 0
