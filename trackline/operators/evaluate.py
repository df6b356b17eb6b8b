"""Portfolios against a benchmark: returns, tracking error, drawdowns, summaries.

A `series` has port_ret and bench_ret by date, and any grouping columns (a model, a scenario) that callers
name in `by`. Windows are partitioned by these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def active() -> Column:
    return F.col("port_ret") - F.col("bench_ret")


def ordered(by: list[str], start: int | None = None) -> WindowSpec:
    first = Window.unboundedPreceding if start is None else start
    return Window.partitionBy(*by).orderBy("date").rowsBetween(first, 0)


def weighted_return(returns: DataFrame, weights: DataFrame | None, name: str) -> DataFrame:
    """date, `name`: the sum of weight times return; equal weights of the assets with a return if none are given."""
    r = returns.filter("ret IS NOT NULL")
    if weights is None:
        return r.groupBy("date").agg(F.avg("ret").alias(name))
    return r.join(weights, ["date", "asset"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias(name))


def nav(series: DataFrame, ret: str, by: list[str] = [], name: str = "nav") -> DataFrame:  # noqa: B006
    return series.withColumn(name, F.product(1 + F.col(ret)).over(ordered(by)))


def drawdown(series: DataFrame, value: Column, by: list[str] = [], name: str = "drawdown") -> DataFrame:  # noqa: B006
    """The compounded value over its peak so far, less one. The first peak is the first value."""
    out = series.withColumn("_c", F.product(1 + value).over(ordered(by)))
    return out.withColumn(name, F.col("_c") / F.max("_c").over(ordered(by)) - 1).drop("_c")


def rolling_te(series: DataFrame, window: int, ann: int, by: list[str] = [], least: int | None = None) -> DataFrame:  # noqa: B006
    """Annualised deviation of active returns; null until the window is full, or until `least` values."""
    w = ordered(by, -(window - 1))
    te = F.when(F.count(active()).over(w) >= (window if least is None else least), F.stddev_samp(active()).over(w) * F.sqrt(F.lit(float(ann))))
    return series.withColumn("te", te)


def carry_forward(series: DataFrame, metric: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return series.withColumn(metric, F.last(metric, ignorenulls=True).over(ordered(by)))


def expost_metrics(series: DataFrame, ann: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """One row a group: counts, tracking error, information ratio, errors and gross compounded values."""
    sd = F.stddev_samp(active())
    out = series.groupBy(*by).agg(
        F.count("*").alias("n"), sd.alias("te_daily"), (sd * F.sqrt(F.lit(float(ann)))).alias("te_ann"), (F.avg(active()) * ann).alias("active_mean_ann"),
        F.avg(active() * active()).alias("mse"), F.avg(F.abs(active())).alias("mae"), F.product(1 + F.col("bench_ret")).alias("bench_cum"), F.product(1 + F.col("port_ret")).alias("port_cum"),
    )
    return out.withColumns({"information_ratio": F.try_divide("active_mean_ann", "te_ann"), "rel_cum": F.try_divide("port_cum", "bench_cum") - 1})


def te_metrics(series: DataFrame, ann: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Tracking error as a root mean square, not a deviation."""
    mse = F.avg(active() * active())
    return series.groupBy(*by).agg(F.count("*").alias("n"), mse.alias("te_mse"), F.avg(F.abs(active())).alias("te_mae"), F.sqrt(mse).alias("te_vol"), (F.sqrt(mse) * F.sqrt(F.lit(float(ann)))).alias("te_ann"))


def yearly(series: DataFrame, ann: int, by: list[str] = [], after: int | None = None) -> DataFrame:  # noqa: B006
    """A row for each year and one, `year` 0, for the whole period: active return, tracking error, ratio."""
    s = series.withColumn("year", F.year("date"))
    if after is not None:
        s = s.filter(F.col("year") > after)
    sd = F.stddev_samp(active()) * F.sqrt(F.lit(float(ann)))
    measures = [F.count("*").alias("n"), (F.product(1 + F.col("port_ret")) - F.product(1 + F.col("bench_ret"))).alias("active_return"), sd.alias("te"), F.datediff(F.max("date"), F.min("date")).alias("_d")]
    both = s.groupBy(*by, "year").agg(*measures).unionByName(s.groupBy(*by).agg(*measures).withColumn("year", F.lit(0)))
    years = F.col("_d") / 365.25
    return both.withColumns({"ir": F.try_divide("active_return", "te"), "active_return_ann": F.try_divide(F.col("active_return"), years)}).drop("_d")


def moments(value: Column, prefix: str) -> list[Column]:
    """Population skew and excess kurtosis."""
    return [F.skewness(value).alias(f"skewness_{prefix}"), F.kurtosis(value).alias(f"kurtosis_{prefix}")]


def turnover(weights: DataFrame, by: list[str] = [], ann: int | None = None) -> DataFrame:  # noqa: B006
    """date, turnover: half the sum of weight changes from one date to the next; absent weights are zero.

    With `ann`, one row a group: the mean of the turnovers above 1e-6, annualised.
    """
    dates = weights.select(*by, "date").distinct()
    dates = dates.withColumn("_next", F.lead("date").over(Window.partitionBy(*by).orderBy("date")))
    now = weights.select(*by, "date", "asset", "weight")
    back = now.join(dates, [*by, "date"]).filter("_next IS NOT NULL").select(*by, F.col("_next").alias("date"), "asset", (-F.col("weight")).alias("weight"))
    first = dates.groupBy(*by).agg(F.min("date").alias("_first")) if by else dates.agg(F.min("date").alias("_first"))
    change = now.union(back).groupBy(*by, "date", "asset").agg(F.sum("weight").alias("d"))
    out = change.groupBy(*by, "date").agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    out = (out.join(first, by) if by else out.crossJoin(F.broadcast(first))).filter("date > _first").drop("_first")
    if ann is None:
        return out
    return out.filter("turnover > 1e-6").groupBy(*by).agg((F.avg("turnover") * ann).alias("turnover_ann"))


def scenario_summary(series: DataFrame, ann: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The summary row of a scenario, but for its turnover: sixteen measures."""
    root = F.sqrt(F.lit(float(ann)))
    keyed = series.withColumns({"year": F.year("date"), "active": active()})
    peak = drawdown(keyed, F.col("active"), by, "dd")
    year = keyed.groupBy(*by, "year").agg(F.when(F.count("active") > 5, F.stddev_samp("active") * root).alias("te"), (F.product(1 + F.col("active")) - 1).alias("r"))
    years = year.groupBy(*by).agg(F.stddev_samp("te").alias("te_stability"), F.min("r").alias("worst_year_active"), F.max("r").alias("best_year_active"))
    bear, bull = F.when(F.col("bench_ret") < 0, F.col("active")), F.when(F.col("bench_ret") >= 0, F.col("active"))
    total = peak.groupBy(*by).agg(
        F.stddev_samp("active").alias("te_daily"), (F.stddev_samp("active") * root).alias("te_ann"), (F.avg("active") * ann).alias("active_mean_ann"),
        (F.product(1 + F.col("port_ret")) - 1).alias("port_cum"), (F.product(1 + F.col("bench_ret")) - 1).alias("bench_cum"), F.min("dd").alias("max_dd_active"), *moments(F.col("active"), "active"),
        F.when(F.count(bear) > 5, F.stddev_samp(bear) * root).alias("te_ann_bear"), F.when(F.count(bull) > 5, F.stddev_samp(bull) * root).alias("te_ann_bull"),
    )
    total = total.withColumns({"information_ratio": F.try_divide("active_mean_ann", "te_ann"), "rel_cum_vs_bench": F.col("port_cum") - F.col("bench_cum")})
    return total.join(years, by) if by else total.crossJoin(F.broadcast(years))


def with_turnover(summary: DataFrame, weights: DataFrame, ann: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """A summary with turnover_ann and te_per_unit_turnover, from the weights by..., date, asset, weight."""
    moved = turnover(weights, by, ann)
    out = summary.join(moved, by, "left") if by else summary.crossJoin(F.broadcast(moved))
    return out.withColumn("te_per_unit_turnover", F.try_divide("te_ann", "turnover_ann"))


def yearly_series(series: DataFrame, ann: int, window: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The yearly rows of a scenario. `te_expost` is the deviation of the rolling tracking error; `te_year` that
    of the year's active returns. Skew and kurtosis are the bias-corrected ones."""
    root = F.sqrt(F.lit(float(ann)))
    s = rolling_te(series, window, ann, by).withColumns({"year": F.year("date"), "active": active()})
    s = drawdown(s, F.col("active"), [*by, "year"], "dd")
    n = F.count("active").cast("double")
    skew = F.when(n > 2, F.skewness("active") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.kurtosis("active") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    gain = lambda c: F.product(1 + F.col(c)) - 1
    return s.groupBy(*by, "year").agg(
        gain("port_ret").alias("port_return"), gain("bench_ret").alias("bench_return"), gain("active").alias("active_return"), (F.stddev_samp("te") * root).alias("te_expost"), (F.stddev_samp("active") * root).alias("te_year"),
        F.min("dd").alias("max_dd_active_yr"), skew.alias("skewness_active_yr"), kurt.alias("kurtosis_active_yr"),
    )


def best_model(metrics: DataFrame, measures: list[str]) -> DataFrame:
    """measure, best, votes: the model with the least value of each measure, and how often a model wins."""
    rows = metrics.select("model", F.stack(F.lit(len(measures)), *[x for m in measures for x in (F.lit(m), F.col(m))]).alias("measure", "value"))
    best = rows.filter("value IS NOT NULL").groupBy("measure").agg(F.min_by("model", F.struct("value", "model")).alias("best"))
    return best.withColumn("votes", F.count("*").over(Window.partitionBy("best")))
