"""Core weights against a plain walk over the rules, date by date."""

import random

import pytest

from trackline.operators import allocation


def plain(rows, excluded, mode, budget, threshold, eps=1e-12):
    """rows: asset -> (sector, weight); the rules of core_weights() for one date, one after another."""
    w = {a: v or 0.0 for a, (_, v) in rows.items()}
    sector = {a: s or "UNKNOWN" for a, (s, _) in rows.items()}
    if sum(w.values()) <= eps:
        w = dict.fromkeys(w, 1 / len(w))
    budget = min(max(budget, 0), 1)
    frozen = {a for a in w if threshold and w[a] >= threshold and a not in excluded}
    out = {a: 0.0 if a in excluded else w[a] * budget for a in w}
    held = sum(out[a] for a in frozen)
    rest = budget - held
    if rest < -1e-10:
        return out | {a: out[a] / held * budget for a in frozen}
    free = [a for a in w if a not in excluded and a not in frozen]
    if rest <= eps or not free:
        return out

    def deal(names, amount):
        score = {a: 1 / max(w[a], eps) if mode.endswith("inv") else max(w[a], 0) for a in names}
        total = sum(score.values())
        return {a: amount * score[a] / total if total > eps else amount / len(names) for a in names}

    if mode.startswith("global"):
        return out | deal(free, rest)
    own = {}
    for s in set(sector.values()):
        own[s] = sum(w[a] for a in w if sector[a] == s) * budget - sum(out[a] for a in frozen if sector[a] == s)
    names = {s: [a for a in free if sector[a] == s] for s in own}
    spill = sum(v for s, v in own.items() if v > eps and not names[s])
    live = sum(v for s, v in own.items() if v > eps and names[s])
    if spill > eps and live <= eps:
        return out | deal(free, rest)
    for s, v in own.items():
        if v > eps and names[s]:
            out |= deal(names[s], v * (1 + spill / live) if spill > eps else v)
    total, loose = sum(out.values()), sum(v for a, v in out.items() if a not in frozen)
    if abs(total - budget) > 1e-8 and total > eps and loose > eps:
        out |= {a: v * (rest / loose if rest > -eps else 0) for a, v in out.items() if a not in frozen}
    return out


def dates(seed):
    """Benchmarks that sum to one or not, with sectors that are frozen or excluded as a whole, zero weights and nulls."""
    r, out = random.Random(seed), {}
    for d in range(40):
        n = r.randint(1, 9)
        raw = [r.choice([None, 0.0, r.random(), r.random() ** 4]) for _ in range(n)]
        total = sum(v or 0 for v in raw) or 1
        scale = r.choice([1.0, 1.0, 1.0, 2.5, 0.4])
        out[d] = {f"a{k}": (r.choice([None, "x", "y", "z"]), None if v is None else v / total * scale) for k, v in enumerate(raw)}
    return out


@pytest.mark.parametrize("mode", allocation.MODES)
@pytest.mark.parametrize(("budget", "threshold", "excluded"), [(1.0, None, []), (0.6, 0.2, ["a1"]), (0.8, 0.05, ["a0", "a2"]), (1.5, 0.3, ["a3"]), (0.0, 0.1, [])])
def test_core_weights_follow_the_rules(spark, mode, budget, threshold, excluded):
    days = dates(len(mode) + int(10 * budget))
    bench = spark.createDataFrame([(d, a, s, w) for d, own in days.items() for a, (s, w) in own.items()], "date int, asset string, sector string, weight double")
    out = spark.createDataFrame([(a,) for a in [*excluded, "elsewhere", *excluded]], "asset string")
    got = {(r.date, r.asset): r.weight for r in allocation.core_weights(bench, out, mode, budget, threshold).collect()}
    want = {(d, a): v for d, own in days.items() for a, v in plain(own, set(excluded), mode, budget, threshold).items()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_frozen_goals_above_the_budget_are_scaled(spark):
    bench = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.6), ("c", "y", 0.1)], "asset string, sector string, weight double").selectExpr("1 AS date", "*")
    got = {r.asset: r.weight for r in allocation.core_weights(bench, spark.createDataFrame([], "asset string"), "sector_prop", 0.5, 0.5).collect()}
    assert got == pytest.approx({"a": 0.3, "b": 0.2, "c": 0.05})
    with pytest.raises(ValueError, match="no such mode"):
        allocation.core_weights(bench, bench, "other")
