"""Grouped matrix work: covariances, optimal allocations and volatility fits, one group of rows a task call.

A group is one window (its length times the universe), one asset's history or one scenario, so what a task
holds is bounded by these and not by the number of groups. Groups run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions import kernels


def _square(rows: pd.DataFrame, value: str = "ret", index: str = "date") -> tuple[list[str], np.ndarray]:
    """Assets in order, and dates by assets."""
    wide = rows.pivot(index=index, columns="asset", values=value).sort_index()
    return list(wide.columns), wide.to_numpy(float)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by key over all shuffle partitions: fits take long for few bytes, so partitions must not be merged by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def covariances(windows: DataFrame, methods: list[str], by: str = "rebal_date") -> DataFrame:
    """model, by, i, j, cov (i <= j) of each window by each method; methods: names of kernels.ESTIMATORS."""
    kind = windows.schema[by].dataType.simpleString()
    rows = windows.select(by, "date", "asset", "ret", F.explode(F.array(*[F.lit(m) for m in methods])).alias("model"))

    def estimate(key, rows: pd.DataFrame) -> pd.DataFrame:
        names, x = _square(rows)
        cov = kernels.on_active(x, kernels.ESTIMATORS[key[0]])
        i, j = np.triu_indices(len(names))
        at = np.array(names, object)
        return pd.DataFrame({"model": key[0], by: key[1], "i": at[i], "j": at[j], "cov": cov[i, j]})

    return rows.groupBy("model", by).applyInPandas(estimate, f"model string, {by} {kind}, i string, j string, cov double")


def tracking_minimal(cov: DataFrame, bench: DataFrame, excluded: DataFrame | None = None, by: str = "rebal_date") -> DataFrame:
    """model, by, asset, weight, te_ante, var_ante, n_kept: the weights of least tracking error at each date.

    cov: model, by, i, j, cov. bench: by, asset, weight, and kept (boolean) if assets may be held
    back. Assets of the benchmark that are kept, not excluded, and have a variance are held; where none is, the benchmark itself.
    """
    kind = cov.schema[by].dataType.simpleString()
    left = bench.select(by, "asset", "weight", F.col("kept") if "kept" in bench.columns else F.lit(True).alias("kept"))
    if excluded is not None:
        left = left.join(F.broadcast(excluded.select("asset", F.lit(True).alias("_x"))), "asset", "left").select(by, "asset", "weight", F.col("_x").isNull().alias("kept"))

    def solve(key, c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["weight"] > 0].sort_values("asset")
        if not len(b) or not len(c):
            # A date without a covariance has no weights; object columns let any type be empty.
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("model", by, "asset", "weight", "te_ante", "var_ante", "n_kept")})
        at = {a: k for k, a in enumerate(b["asset"])}
        out = []
        for model, own in c.groupby("model", sort=True):
            s = np.zeros((len(at),) * 2)
            own = own[own["i"].isin(at) & own["j"].isin(at)]
            i, j = own["i"].map(at).to_numpy(int), own["j"].map(at).to_numpy(int)
            s[i, j] = s[j, i] = own["cov"].to_numpy()
            weight = b["weight"].to_numpy() / b["weight"].sum()
            kept = np.flatnonzero(b["kept"].to_numpy() & (np.diag(s) > 1e-12))
            w = weight.copy()
            if len(kept):
                w = np.zeros(len(at))
                w[kept] = kernels.minimise_tracking(s, weight, kept)
            d = w - weight
            out.append(pd.DataFrame({"model": model, by: key[0], "asset": b["asset"].to_numpy(), "weight": w, "te_ante": np.sqrt(max(d @ s @ d, 0)), "var_ante": w @ s @ w, "n_kept": len(kept)}))
        return pd.concat(out)

    # Renamed, since both sides may come from one table.
    cov = cov.select("model", F.col(by).alias("_key"), "i", "j", "cov")
    return cov.groupBy("_key").cogroup(left.groupBy(by)).applyInPandas(solve, f"model string, {by} {kind}, asset string, weight double, te_ante double, var_ante double, n_kept long")


def volatility_fits(returns: DataFrame, kinds: list[str], ps: tuple[int, ...] = (1,), qs: tuple[int, ...] = (1,)) -> DataFrame:
    """asset, model, p, q, params, llf, aic, bic, converged, message, sigma, path: a fit for each asset, model and order.

    path holds the conditional deviation of each of the asset's returns, in the order of dates."""
    each = lambda c, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(c)
    rows = returns.select("asset", "date", "ret", each("model", kinds)).select("*", each("p", ps)).select("*", each("q", qs))

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        asset, model, p, q = key
        found = kernels.fit_volatility(model, rows.sort_values("date")["ret"].to_numpy(float), p, q)
        return pd.DataFrame([{"asset": asset, "model": model, "p": p, "q": q} | found])

    return _dealt(rows, "asset", "model", "p", "q").groupBy("asset", "model", "p", "q").applyInPandas(fit, "asset string, model string, p int, q int, params map<string,double>, llf double, aic double, bic double, converged boolean, message string, sigma double, path array<double>")


def select_model(fits: DataFrame, criterion: str = "bic", by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """The fit of least criterion of each asset, or of each asset and model; ties go to the smaller order."""
    what = [c for c in ("model", "p", "q", "llf", "aic", "bic", "sigma") if c not in by]
    order = F.struct(criterion, *[c for c in ("model", "p", "q") if c not in by])
    return fits.filter(F.col(criterion).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*what), order).alias("b")).select(*by, "b.*")


def dcc_refits(returns: DataFrame, calendar: DataFrame, every: int, lookback: int, volatility: str = "ewma") -> DataFrame:
    """refit, date, a, b, i, j, cov (i <= j): the covariance that the DCC model expects of each date.

    The model is fitted to the `lookback` dates before each `every`th date, the first that has as many before it
    included, and then takes one step a date up to the next fit. One group a fit; groups run in parallel.
    """
    at = calendar.select("date", "idx")
    # A date belongs to its own segment, and to the lookbacks that reach it.
    segment = lambda k: F.floor((k - lookback) / every)
    first, last = F.greatest(segment(F.col("idx")), F.lit(0)), segment(F.col("idx") + lookback)
    end = F.lit(at.agg(F.max("idx")).first()[0] or 0)
    spans = at.withColumn("refit", F.explode(F.sequence(first, last))).withColumn("start", F.col("refit") * every + lookback)
    spans = spans.filter((F.col("start") <= end) & (F.col("idx") >= F.col("start") - lookback)).select("date", "refit", (F.col("idx") >= F.col("start")).alias("ahead"))
    rows = returns.select("date", "asset", "ret").join(spans, "date")
    kind = returns.schema["date"].dataType.simpleString()

    def follow(key, rows: pd.DataFrame) -> pd.DataFrame:
        names, x = _square(rows)
        ahead = rows.groupby("date")["ahead"].first().sort_index()
        n = int((~ahead).sum())
        state = kernels.dcc_fit(x[:n], volatility=volatility)
        i, j = np.triu_indices(len(names))
        at, out = np.array(names, object), []
        for date, r in zip(ahead.index[n:], x[n:], strict=True):
            out.append(pd.DataFrame({"refit": key[0], "date": date, "a": state["a"], "b": state["b"], "i": at[i], "j": at[j], "cov": kernels.dcc_covariance(state)[i, j]}))
            state = kernels.dcc_step(state, r)
        return pd.concat(out)

    return _dealt(rows, "refit").groupBy("refit").applyInPandas(follow, f"refit long, date {kind}, a double, b double, i string, j string, cov double")


def threshold_rebalances(series: DataFrame, by: list[str], threshold: float, window: int, ann: int, cooldown: int = 0) -> DataFrame:
    """by..., date, te: the dates on which the tracking error of the last `window` dates exceeds the threshold and
    no such date lies within the cooldown. Each decision depends on the last, so a scenario is one group."""
    fields = ", ".join(f"{b} {series.schema[b].dataType.simpleString()}" for b in by)

    def walk(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        a = (rows["port_ret"] - rows["bench_ret"]).to_numpy(float)
        out, last = [], -(10**9)
        for t in range(window - 1, len(a)):
            own = a[t - window + 1 : t + 1]
            own = own[np.isfinite(own)]
            if len(own) < max(10, window // 3) or t - last <= cooldown:
                continue
            te = own.std(ddof=1) * np.sqrt(ann)
            if te > threshold:
                out.append((*key, rows["date"].iloc[t], te))
                last = t
        return pd.DataFrame(out, columns=[*by, "date", "te"])

    return series.groupBy(*by).applyInPandas(walk, f"{fields}, date date, te double")


def positions_backtest(targets: DataFrame, prices: DataFrame, by: list[str], value: float, bps: float = 0.0) -> DataFrame:
    """by..., date, nav, cash, n_trades: whole shares bought at each target's date and held between.

    targets: by..., date, asset, weight; prices: date, asset, price. Shares and cash depend on all earlier
    trades, so a scenario is one group.
    """
    fields = ", ".join(f"{b} {targets.schema[b].dataType.simpleString()}" for b in by)
    first = targets.groupBy(*by).agg(F.min("date").alias("_first"))
    days = prices.join(first, F.col("date") >= F.col("_first")).drop("_first")
    rows = days.join(targets, [*by, "date", "asset"], "left").select(*by, "date", "asset", "price", "weight")

    def walk(key, rows: pd.DataFrame) -> pd.DataFrame:
        names, price = _square(rows, "price")
        _, weight = _square(rows, "weight")
        dates = np.sort(rows["date"].unique())
        shares, cash, out = np.zeros(len(names)), value, []
        price = pd.DataFrame(price).ffill().fillna(0).to_numpy()
        for d, p, w in zip(dates, price, weight, strict=True):
            nav, trades = cash + shares @ p, 0
            if np.isfinite(w).any():
                w = np.nan_to_num(w)
                goal = np.floor(np.divide(w / w.sum() * nav, p, out=np.zeros(len(p)), where=p > 0)) if w.sum() > 0 else shares
                change = goal - shares
                fee = bps / 1e4 * np.abs(change * p).sum()
                need = change @ p + fee
                if need > cash:
                    up = change > 0
                    change[up] = np.floor(change[up] * max(0.0, 1 - (need - cash) / max((change[up] * p[up]).sum(), 1e-12)))
                    fee = bps / 1e4 * np.abs(change * p).sum()
                cash -= change @ p + fee
                shares, trades = shares + change, int((change != 0).sum())
            out.append((*key, d, cash + shares @ p, cash, trades))
        return pd.DataFrame(out, columns=[*by, "date", "nav", "cash", "n_trades"])

    return rows.groupBy(*by).applyInPandas(walk, f"{fields}, date date, nav double, cash double, n_trades long")


def tracking_minimal_ordered(cov: DataFrame, bench: DataFrame, excluded: DataFrame | None = None, run: int = 12, ridge: float = 0.0, warm: bool = True, by: str = "rebal_date") -> DataFrame:
    """model, by, asset, weight, rounds: tracking_minimal() solved in the order of dates, each from the weights before.

    `run` consecutive dates are a group, so that runs of one model go in parallel and a task holds that many
    covariances; the first of a run starts from its benchmark. What a start leaves fixed at zero is freed where it should
    be, so without `ridge` the weights don't depend on the start. With it, ridge |w - start|^2 in units of the mean
    variance holds weights near those before.
    """
    kind = bench.schema[by].dataType.simpleString()
    dates = bench.select(by).distinct().withColumn("_run", F.floor((F.row_number().over(Window.orderBy(by)) - 1) / run).cast("int"))
    left = bench.select(by, "asset", "weight").filter("weight > 0")
    out = excluded.select("asset").distinct().withColumn("_x", F.lit(True)) if excluded is not None else None
    left = left.join(out, "asset", "left").withColumn("kept", F.col("_x").isNull()) if out is not None else left.withColumn("kept", F.lit(True))
    models = cov.select("model").distinct()
    # Renamed, since both sides may come from one table.
    benches = left.join(dates, by).crossJoin(F.broadcast(models)).select(F.col("model").alias("_model"), F.col("_run").alias("_own"), F.col(by).alias("_key"), "asset", "weight", "kept")
    covs = cov.join(dates, by).select("model", "_run", F.col(by).alias("_key"), "i", "j", "cov")

    def solve(key, c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found, before = [], {}
        for date, own in b.sort_values(["_key", "asset"]).groupby("_key", sort=True):
            part = c[c["_key"] == date]
            if not len(part):
                continue
            names = own["asset"].to_numpy()
            at, weight = {a: k for k, a in enumerate(names)}, own["weight"].to_numpy(float) / own["weight"].sum()
            part = part[part["i"].isin(at) & part["j"].isin(at)]
            s = np.zeros((len(at),) * 2)
            i, j = part["i"].map(at).to_numpy(int), part["j"].map(at).to_numpy(int)
            s[i, j] = s[j, i] = part["cov"].to_numpy()
            kept, w, n = np.flatnonzero(own["kept"].to_numpy(bool) & (np.diag(s) > 1e-12)), weight.copy(), 0
            if len(kept):
                first = np.array([before.get(a, 0.0) for a in names]) if warm and before else weight
                w = np.zeros(len(at))
                w[kept], n = kernels.solve_tracking(s, weight, kept, start=first, ridge=ridge)
            before = dict(zip(names, w, strict=True))
            found.append(pd.DataFrame({"model": key[0], by: date, "asset": names, "weight": w, "rounds": n}))
        return pd.concat(found) if found else pd.DataFrame({x: pd.Series([], dtype=object) for x in ("model", by, "asset", "weight", "rounds")})

    return covs.groupBy("model", "_run").cogroup(benches.groupBy("_model", "_own")).applyInPandas(solve, f"model string, {by} {kind}, asset string, weight double, rounds int")


def tracking_minimal_scenarios(cov: DataFrame, bench: DataFrame, excluded: DataFrame, scenarios: DataFrame, together: int = 256, by: str = "rebal_date") -> DataFrame:
    """model, scenario, by, asset, weight, te_ante, var_ante, n_kept: tracking_minimal() for many sets of exclusions.

    cov: model, by, i, j, cov; bench: by, asset, weight; excluded: scenario, asset; scenarios: scenario. A date's covariances
    meet up to `together` scenarios, each a list of what it leaves out, in one group, so they are copied once for that
    many scenarios and not for each.
    """
    kind, name = bench.schema[by].dataType.simpleString(), scenarios.schema["scenario"].dataType.simpleString()
    chunks = max(1, -(-scenarios.count() // together))
    out = excluded.groupBy("scenario").agg(F.collect_set("asset").alias("left"))
    lists = scenarios.select("scenario").distinct().join(out, "scenario", "left").withColumn("chunk", F.pmod(F.xxhash64("scenario"), F.lit(chunks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    # One table of what a date shares, covariances and benchmark alike; the other of its scenarios.
    shared = cov.select(F.col(by).alias("_key"), "model", "i", "j", "cov").unionByName(bench.select(F.col(by).alias("_key"), F.lit(None).cast("string").alias("model"), F.col("asset").alias("i"), F.lit(None).cast("string").alias("j"), F.col("weight").alias("cov")))
    shared = shared.select("*", every)
    asked = bench.select(F.col(by).alias("_key")).distinct().select("*", every).join(lists, "chunk")

    def solve(key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["model", "scenario", by, "asset", "weight", "te_ante", "var_ante", "n_kept"]
        none = pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        b = own[own["model"].isna() & (own["cov"] > 0)].sort_values("i")
        if not len(b) or not len(asked):
            return none
        names = b["i"].to_numpy()
        at, weight, found = {a: k for k, a in enumerate(names)}, b["cov"].to_numpy(float) / b["cov"].sum(), []
        for model, c in own[own["model"].notna()].groupby("model", sort=True):
            s = np.zeros((len(at),) * 2)
            c = c[c["i"].isin(at) & c["j"].isin(at)]
            i, j = c["i"].map(at).to_numpy(int), c["j"].map(at).to_numpy(int)
            s[i, j] = s[j, i] = c["cov"].to_numpy()
            for scenario, left in asked.sort_values("scenario")[["scenario", "left"]].itertuples(index=False):
                kept = np.flatnonzero((np.diag(s) > 1e-12) & ~np.isin(names, [] if left is None else list(left)))
                w = weight.copy()
                if len(kept):
                    w = np.zeros(len(at))
                    w[kept] = kernels.minimise_tracking(s, weight, kept)
                d = w - weight
                found.append(pd.DataFrame({"model": model, "scenario": scenario, by: key[0], "asset": names, "weight": w, "te_ante": np.sqrt(max(d @ s @ d, 0)), "var_ante": w @ s @ w, "n_kept": len(kept)}))
        return pd.concat(found) if found else none

    return shared.groupBy("_key", "chunk").cogroup(asked.groupBy("_key", "chunk")).applyInPandas(solve, f"model string, scenario {name}, {by} {kind}, asset string, weight double, te_ante double, var_ante double, n_kept long")
