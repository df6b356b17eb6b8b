"""Backtests day by day: calendars and rules that decide, orders that wait, drift, costs, cash, flows and whole shares.

What no decision changes is computed once, as rows: the panel, the benchmark's path in closed form, the candidate
targets of every date. Only what depends on its own past is walked in order, one scenario after another: weights in
force, the rule that looks back on realised returns, shares and cash. Scenarios are dealt into buckets; a bucket
gets one copy of the panel, however many scenarios it holds, and their targets as vectors.

Order of a day: a waiting target takes effect; the day's return is earned and weights drift; flows arrive; with whole
shares, the waiting target is traded at the close; then a calendar or a rule may decide, and the target of that
date waits for `apply_lag` days. A decision without a target is passed over. Missing returns count as zero.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.operators import calendars, covariance, drift, evaluate, events, matrix
from trackline.sources.shared import stored

#: Weights of targets that one bucket holds, about.
HELD = 20_000_000
_TINY = 1e-12


@dataclass(frozen=True)
class Shares:
    """How a book of shares is bought and traded."""

    reserve: float = 0.0
    min_weight: float = 0.0
    min_position: float = 0.0
    min_trade: float = 0.0
    lot: int = 1
    fractional: bool = False
    rounding: str = "floor"
    cash_return: float = 0.0

    def wanted(self, weights: np.ndarray, price: np.ndarray, value: float) -> np.ndarray:
        """The shares of a target."""
        w = np.where(np.abs(weights) < self.min_weight, 0, weights)
        budget = (1 - min(max(self.reserve, 0), 1)) * value
        money = w / w.sum() * budget if w.sum() > _TINY else np.zeros(len(w))
        if self.min_position > 0:
            money = np.where(money < self.min_position, 0, money)
            money = money * (budget / money.sum()) if money.sum() > _TINY else money
        raw = np.divide(money, price, out=np.zeros(len(w)), where=price > 0)
        if not self.fractional:
            step = max(self.lot, 1)
            raw = (np.round(raw / step) if self.rounding == "round" else np.floor(raw / step)) * step
        return np.maximum(raw, 0)

    def trades(self, have: np.ndarray, want: np.ndarray, price: np.ndarray, cash: float) -> np.ndarray:
        """The change of shares: small trades are left, and purchases that cash and sales can't pay are scaled down to
        whole shares, or left out if nothing is there to pay with."""
        change = want - have
        change = np.where(np.abs(change) * price >= self.min_trade, change, 0) if self.min_trade > 0 else change
        if cash - change @ price < -1e-6:
            buy, sell = np.maximum(change, 0), np.maximum(-change, 0)
            there = cash + sell @ price
            change = np.floor(buy * min(1, there / (buy @ price))) - sell if buy @ price > _TINY and there > 0 else -sell
        return change


@dataclass(frozen=True)
class Settings:
    apply_lag: int = 1
    bps: float = 0.0
    fixed: float = 0.0
    #: Without shares: take the cost of a decision off the return of its day.
    charge: bool = False
    start: float = 1.0
    shares: Shares | None = None

    def cost(self, before: np.ndarray, after: np.ndarray) -> float:
        """The fraction of the value that a change of weights costs."""
        return max(self.bps / 1e4 * np.abs(after - before).sum() + self.fixed, 0.0)


@dataclass(frozen=True)
class Rule:
    """Decides when the tracking error of the last `window` days exceeds a threshold, `cooldown` days apart at least."""

    threshold: float
    window: int
    cooldown: int
    ann: float

    def fires(self, i: int, active: np.ndarray, last: int | None) -> bool:
        if i <= 1 or self.window <= 1 or i - self.window + 1 < 0 or (self.cooldown > 0 and last is not None and i - last < self.cooldown):
            return False
        own = active[i - self.window + 1 : i + 1]
        own = own[np.isfinite(own)]
        return len(own) >= max(10, self.window // 3) and own.std(ddof=1) * math.sqrt(self.ann) > self.threshold


def _drifted(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    gross = w * (1 + r)
    total = gross.sum()
    if np.isfinite(total) and total > 0:
        return gross / total
    return w / w.sum() if w.sum() > _TINY else np.full(len(w), 1 / len(w))


def _share(shares: np.ndarray, price: np.ndarray) -> np.ndarray:
    held = shares * price
    return held / held.sum() if held.sum() > _TINY else np.zeros(len(held))


def walk(ret: np.ndarray, price: np.ndarray | None, bench: np.ndarray, flow: np.ndarray, first: np.ndarray, targets: dict[int, np.ndarray], calendar: set[int], rule: Rule | None, s: Settings) -> list[tuple]:
    """port_ret, nav, cash, cost, n_trades, decided, traded and closing weights of each day of one scenario."""
    book, waiting, last = s.shares, {}, None
    w, nav, cash, shares = first, s.start, 0.0, None
    if book:
        shares = book.wanted(first, price[0], s.start)
        cash = s.start - shares @ price[0]
        w = _share(shares, price[0])
    active = np.full(len(ret), np.nan)
    active[0] = -bench[0]
    out = [(0.0, nav, cash, 0.0, 0, None, False, w)]
    for i in range(1, len(ret)):
        cost, n, traded = 0.0, 0, i in waiting
        if book:
            before = shares @ price[i - 1] + cash
            cash *= 1 + book.cash_return
            now = shares @ price[i] + cash
            earned = now / before - 1 if before > 0 else 0.0
            cash += flow[i]
            nav, w = now + flow[i], _share(shares, price[i])
        else:
            w = waiting.pop(i, w)
            earned = float(w @ ret[i])
            nav = nav * (1 + earned) + flow[i]
            w = _drifted(w, ret[i])
        active[i] = earned - bench[i]
        if book and traded:
            goal = waiting.pop(i)
            cost = s.cost(w, goal)
            cash, nav = cash - cost * nav, nav * (1 - cost)
            change = book.trades(shares, book.wanted(goal, price[i], nav), price[i], cash)
            shares, cash, n = shares + change, cash - change @ price[i], int((change != 0).sum())
            w = _share(shares, price[i])
        decided = "calendar" if i in calendar else None
        if decided is None and rule is not None and rule.fires(i, active, last):
            decided, last = "rule", i
        if decided and i in targets:
            if s.charge and not book:
                cost = s.cost(w, targets[i])
                earned, nav = earned - cost, nav * (1 - cost)
                active[i] = earned - bench[i]
            waiting[i + s.apply_lag] = targets[i]
        elif decided:
            decided = None
        out.append((earned, nav, cash, cost, n, decided, traded, w))
    return out


def _vector(names: list[str], value: str, default: float = 0.0):
    """A group's `value` by asset, in the order of names."""
    by = F.map_from_entries(F.collect_list(F.struct("asset", F.col(value).cast("double"))))
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.try_element_at(by, n), F.lit(default)))


def run(panel: DataFrame, bench: DataFrame, first: DataFrame, targets: DataFrame, calendar: DataFrame, scenarios: DataFrame, ann: float, settings: Settings = Settings(), flows: DataFrame | None = None, buckets: int | None = None) -> DataFrame:  # noqa: B008
    """scenario, date, port_ret, bench_ret, nav, cash, cost, n_trades, decided, traded, close (asset to weight) of each day.

    panel: date, asset, ret, and price if settings ask for shares; bench: date, bench_ret; first: asset, weight on the
    first day; targets: scenario, date, asset, weight, on every date on which that scenario might decide; calendar:
    scenario, date; scenarios: scenario, threshold, window, cooldown (nulls: no rule); flows: date, flow at the close.
    `decided` tells what made an order (calendar or rule), `traded` that one took effect. A price that is missing is
    the asset's last one.
    """
    if settings.apply_lag < 1:
        raise ValueError("an order takes effect a day after its decision at the earliest")
    kind = scenarios.schema["scenario"].dataType.simpleString()
    # A universe has hundreds of names, and every bucket holds vectors of them.
    names = sorted(r["asset"] for r in panel.select("asset").distinct().collect())
    dates = panel.select("date").distinct()
    cal = dates.withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)
    rows = panel
    held = [_vector(names, "ret").alias("r")]
    if settings.shares:
        so_far = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        rows = panel.withColumn("price", F.last("price", ignorenulls=True).over(so_far))
        held.append(_vector(names, "price").alias("p"))
    days = rows.groupBy("date").agg(*held).join(cal, "date").join(bench.select("date", "bench_ret"), "date", "left")
    days = days.join(flows.groupBy("date").agg(F.sum("flow").alias("flow")), "date", "left") if flows is not None else days.withColumn("flow", F.lit(0.0))
    days = stored(days.select("idx", "date", "r", *(["p"] if settings.shares else []), F.coalesce("bench_ret", F.lit(0.0)).alias("bench_ret"), F.coalesce("flow", F.lit(0.0)).alias("flow")), "backtest-days")
    start = first.agg(_vector(names, "weight").alias("w")).first()["w"]

    wanted = targets.join(cal, "date").groupBy("scenario", "idx").agg(_vector(names, "weight").alias("w"))
    marked = calendar.join(cal, "date").select("scenario", "idx", F.lit(True).alias("by_calendar")).distinct()
    orders = stored(wanted.join(marked, ["scenario", "idx"], "full"), "backtest-orders")
    size = orders.count() * max(len(names), 1)
    many = buckets or max(1, min(scenarios.count(), max(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / HELD))))
    of = F.pmod(F.xxhash64("scenario"), F.lit(many)).cast("int").alias("bucket")
    told = scenarios.select("scenario", F.col("threshold").cast("double").alias("threshold"), F.col("window").cast("int").alias("window"), F.col("cooldown").cast("int").alias("cooldown"))
    # A row without a date for each scenario, so that none is lost.
    no_order = F.lit(None).cast("int").alias("idx"), F.lit(None).cast("array<double>").alias("w"), F.lit(None).cast("boolean").alias("by_calendar")
    mine = told.select("scenario", *no_order, "threshold", "window", "cooldown").union(orders.join(told.select("scenario"), "scenario", "left_semi").select("scenario", "idx", "w", "by_calendar", *[F.lit(None).cast(t) for t in ("double", "int", "int")]))
    copies = days.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def follow(key, mine: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(mine) and len(days):
            days = days.sort_values("idx")
            ret = np.array(days["r"].tolist(), float)
            price = np.array(days["p"].tolist(), float) if settings.shares else None
            when, bench, flow = days["date"].to_numpy(), days["bench_ret"].to_numpy(float), days["flow"].to_numpy(float)
            bench = np.append(0.0, bench[1:])
            for name, own in mine.groupby("scenario", sort=True):
                head = own[own["idx"].isna()].iloc[0]
                rule = None if pd.isna(head["threshold"]) else Rule(head["threshold"], int(head["window"]), int(head["cooldown"] or 0), ann)
                dated = own[own["idx"].notna()]
                goals = {int(i): np.asarray(w, float) for i, w in zip(dated["idx"], dated["w"], strict=True) if w is not None}
                marks = set(dated["idx"][dated["by_calendar"].eq(True)].astype(int))
                for date, b, day in zip(when, bench, walk(ret, price, bench, flow, np.asarray(start, float), goals, marks, rule, settings), strict=True):
                    found.append((name, date, day[0], b, *day[1:]))
        columns = ["scenario", "date", "port_ret", "bench_ret", "nav", "cash", "cost", "n_trades", "decided", "traded", "close"]
        return pd.DataFrame(found, columns=columns) if found else pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})

    out = mine.withColumn("bucket", of).groupBy("bucket").cogroup(copies.groupBy("bucket")).applyInPandas(
        follow, f"scenario {kind}, date date, port_ret double, bench_ret double, nav double, cash double, cost double, n_trades int, decided string, traded boolean, close array<double>"
    )
    return out.withColumn("close", F.map_from_arrays(F.array(*[F.lit(n) for n in names]).cast("array<string>"), "close"))


def from_first_decision(days: DataFrame) -> DataFrame:
    """The days of each scenario from its first decision on, its NAV starting at one; all days, as they are, where there is none."""
    own = Window.partitionBy("scenario")
    rows = days.withColumn("_from", F.min(F.when(F.col("decided").isNotNull(), F.col("date"))).over(own))
    rows = rows.filter("_from IS NULL OR date >= _from").withColumn("_at", F.max(F.when(F.col("date") == F.col("_from"), F.col("nav"))).over(own))
    return rows.withColumn("nav", F.when(F.col("_from").isNull(), F.col("nav")).otherwise(F.try_divide("nav", "_at"))).drop("_from", "_at")


def weights(days: DataFrame) -> DataFrame:
    """scenario, date, asset, weight at the close."""
    return days.select("scenario", "date", F.explode("close").alias("asset", "weight"))


def benchmark_path(returns: DataFrame, composition: DataFrame, resets: DataFrame) -> DataFrame:
    """date, asset, ret, w_in_force, w_close of a benchmark that takes its composition (date, asset, weight) at the close of
    the first date and of each of `resets` (date), and drifts between."""
    at = composition.agg(F.min("date").alias("date")).union(resets.select("date")).distinct()
    held = composition.join(at, "date").filter("weight <> 0").withColumnRenamed("date", "rebal_date")
    total = held.groupBy("rebal_date").agg(F.sum("weight").alias("_t"))
    return drift.drift(returns, held.join(total, "rebal_date").select("rebal_date", "asset", (F.col("weight") / F.col("_t")).alias("weight")))


def candidates(returns: DataFrame, cal: DataFrame, path: DataFrame, at: DataFrame, models: list[str], length: int, data_lag: int = 1, bench_lag: int = 1, excluded: DataFrame | None = None) -> DataFrame:
    """model, date, asset, weight, te_ante, var_ante, n_kept: the weights of least tracking error that a decision on each
    date of `at` (rebal_date) would ask for, from `length` returns up to data_lag dates before, and the benchmark's closing
    weights (path: date, asset, w_close) of bench_lag dates before. Dates with a shorter history have none."""
    window = covariance.windows(returns, cal, at, length, data_lag)
    back = calendars.shift(at.select(F.col("rebal_date").alias("date")), cal, -bench_lag).select(F.col("date").alias("rebal_date"), F.col("shifted").alias("date"))
    bench = back.join(path.select("date", "asset", F.col("w_close").alias("weight")), "date").select("rebal_date", "asset", "weight")
    cov = stored(matrix.covariances(window, models), "candidate-covariances")
    return matrix.tracking_minimal(cov, bench, excluded).withColumnRenamed("rebal_date", "date")


def full_evaluation(returns: DataFrame, composition: DataFrame, schedule: DataFrame, resets: DataFrame, models: list[str], length: int, ann: int, settings: Settings = Settings(), excluded: DataFrame | None = None, data_lag: int = 1, bench_lag: int = 1) -> dict[str, DataFrame]:  # noqa: B008
    """The whole evaluation of covariance models: the tables `days`, `summary`, `yearly`, `economic` and `targets`.

    Each model is a scenario that rebalances on `schedule` (rebal_date) to its weights of least tracking error, against a
    benchmark that is reset on `resets` (date)."""
    spark = returns.sparkSession
    cal = calendars.calendar(returns)
    path = stored(benchmark_path(returns, composition, resets), "benchmark-path")
    bench = drift.path_return(path, "bench_ret")
    first = events.initial_weights(composition, returns.select("asset").distinct() if excluded is None else returns.select("asset").distinct().join(excluded, "asset", "left_anti"))
    found = stored(candidates(returns, cal, path, schedule, models, length, data_lag, bench_lag, excluded), "targets")
    names = spark.createDataFrame([(m,) for m in models], "scenario string")
    none = names.select("scenario", *[F.lit(None).cast(t).alias(c) for c, t in (("threshold", "double"), ("window", "int"), ("cooldown", "int"))])
    days = stored(run(returns, bench, first, found.withColumnRenamed("model", "scenario"), names.crossJoin(F.broadcast(schedule.select(F.col("rebal_date").alias("date")))), none, ann, settings), "backtest")
    cut = from_first_decision(days)
    return {
        "days": cut, "targets": found, "summary": evaluate.scenario_summary(cut, ann, ["scenario"]),
        "yearly": evaluate.yearly(cut, ann, ["scenario"]), "economic": evaluate.expost_metrics(cut, ann, ["scenario"]),
    }
