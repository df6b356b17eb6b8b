"""What happens around a rebalance: inputs that agree, first weights, triggers, orders that wait, costs, flows, the end.

All of it is rows of dates joined to a path; only rules that depend on their own past decisions run in order
(operators/matrix.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.operators import calendars
from trackline.operators.evaluate import active, ordered


def aligned(returns: DataFrame, bench: DataFrame, least: int) -> DataFrame:
    """The returns on the dates that the benchmark has as well; fewer than `least` such dates are an error."""
    common = returns.select("date").distinct().join(bench.select("date").distinct(), "date", "left_semi")
    n = common.agg(F.count("*").alias("_n"))
    enough = F.coalesce(F.when(F.col("_n") < least, F.raise_error(F.lit("too few dates in common")).cast("boolean")), F.lit(True))
    return returns.join(common, "date", "left_semi").crossJoin(F.broadcast(n)).filter(enough).drop("_n")


def project(bench: DataFrame, kept: DataFrame, key: str = "date", strict: bool = False) -> DataFrame:
    """key, asset, weight: the benchmark's weights on the kept assets, scaled to one; equal weights where these sum to
    zero. With `strict`, a kept asset that the benchmark does not hold is an error."""
    # A universe has hundreds of names.
    named = kept.select("asset", F.lit(True).alias("_k"))
    rows = bench.select(key).distinct().crossJoin(F.broadcast(named)).join(bench.select(key, "asset", "weight"), [key, "asset"], "left")
    if strict:
        held = F.coalesce(F.when(F.col("weight").isNull(), F.raise_error(F.concat(F.lit("not in the benchmark: "), "asset")).cast("boolean")), F.lit(True))
        rows = rows.filter(held)
    day = Window.partitionBy(key)
    total, n = F.sum(F.coalesce("weight", F.lit(0.0))).over(day), F.count("*").over(day)
    share = F.when(total > 0, F.coalesce("weight", F.lit(0.0)) / total).otherwise(1 / n)
    return rows.select(key, "asset", share.alias("weight"))


def initial_weights(bench: DataFrame, kept: DataFrame) -> DataFrame:
    """The first date's benchmark, projected."""
    first = bench.agg(F.min("date").alias("date"))
    return project(bench.join(F.broadcast(first), "date"), kept)


def triggers(calendar_dates: DataFrame, rule_dates: DataFrame) -> DataFrame:
    """rebal_date, by_calendar, by_rule: the dates on which a calendar or a rule asks for a rebalance."""
    both = calendar_dates.select("rebal_date", F.lit(True).alias("c"), F.lit(False).alias("r")).union(rule_dates.select("rebal_date", F.lit(False), F.lit(True)))
    return both.groupBy("rebal_date").agg(F.max("c").alias("by_calendar"), F.max("r").alias("by_rule"))


def effective(targets: DataFrame, cal: DataFrame, lag: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Targets at the dates from which they hold: `lag` trading dates after the decision. Orders that would take effect
    on one date are one order, the last; those beyond the calendar never do."""
    moved = calendars.shift(targets.select(F.col("rebal_date").alias("date")).distinct(), cal, lag).filter("shifted IS NOT NULL")
    rows = targets.join(moved.withColumnRenamed("date", "rebal_date"), "rebal_date")
    last = rows.groupBy(*by, "shifted").agg(F.max("rebal_date").alias("rebal_date"))
    return rows.join(last, [*by, "shifted", "rebal_date"]).select(*by, F.col("shifted").alias("rebal_date"), "asset", "weight")


def net_of_costs(series: DataFrame, costs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The series with port_ret less the cost of its date (by..., date, cost): (1 + r)(1 - cost) - 1."""
    out = series.join(costs, [*by, "date"], "left")
    return out.withColumn("port_ret", (1 + F.col("port_ret")) * (1 - F.coalesce("cost", F.lit(0.0))) - 1).drop("cost")


def value_with_flows(series: DataFrame, flows: DataFrame, start: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., date, value: a start that grows by port_ret, with flows (by..., date, flow) paid in at the close.

    With N the growth so far, the value is N (start + sum flow / N): no loop over dates. A return of -1 ends it.
    """
    rows = series.join(flows, [*by, "date"], "left").withColumn("_g", F.product(1 + F.col("port_ret")).over(ordered(by)))
    paid = F.sum(F.try_divide(F.coalesce("flow", F.lit(0.0)), F.col("_g"))).over(ordered(by))
    return rows.select(*by, "date", (F.col("_g") * (start + paid)).alias("value"))


def finalise(series: DataFrame, first: DataFrame, ann: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., n_days, final_nav, te_ann from the first rebalance (one row: rebal_date) on; the NAV starts at one."""
    rows = series.join(F.broadcast(first.agg(F.min("rebal_date").alias("_from"))), F.col("date") >= F.col("_from"))
    rows = rows.withColumn("_n", F.product(1 + F.col("port_ret")).over(ordered(by)))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n_days"), F.min_by("_n", "date").alias("_a"), F.max_by("_n", "date").alias("_b"), (F.stddev_samp(active()) * F.sqrt(F.lit(float(ann)))).alias("te_ann"))
    return ends.select(*by, "n_days", F.try_divide("_b", "_a").alias("final_nav"), "te_ann")


def anchored_navs(navs: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """by..., date, nav: paths that begin later, scaled to the reference's level (date, nav) as of their first date."""
    starts = navs.groupBy(*by).agg(F.min("date").alias("date"))
    levels = calendars.as_of(starts, reference.select(F.col("date").alias("eff_date"), F.col("nav").alias("_level")), [])
    return navs.join(levels.select(*by, "_level"), by).select(*by, "date", (F.col("nav") * F.col("_level")).alias("nav"))


def period_returns(series: DataFrame, rebalances: DataFrame) -> DataFrame:
    """rebal_date, ptf_ret, bench_ret compounded over [rebalance, next rebalance)."""
    spans = calendars.valid_ranges(rebalances.select("rebal_date").distinct(), [], "rebal_date")
    rows = spans.join(series, (F.col("date") >= F.col("rebal_date")) & (F.col("until").isNull() | (F.col("date") < F.col("until"))))
    return rows.groupBy("rebal_date").agg((F.product(1 + F.col("port_ret")) - 1).alias("ptf_ret"), (F.product(1 + F.col("bench_ret")) - 1).alias("bench_ret"))


def ratio_links(days: DataFrame) -> DataFrame:
    """date, link of dates with tp and tb: ((1 + Rp) / cum_p) (cum_b / (1 + Rb)), R over all dates, cum up to each."""
    w = Window.orderBy("date")
    up = days.withColumns({"_p": F.product(1 + F.col("tp")).over(w), "_b": F.product(1 + F.col("tb")).over(w)})
    total = days.agg(F.product(1 + F.col("tp")).alias("_rp"), F.product(1 + F.col("tb")).alias("_rb"))
    return up.crossJoin(F.broadcast(total)).select("date", (F.try_divide("_rp", "_p") * F.try_divide("_b", "_rb")).alias("link"))


def flat_log(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., name, value: a diagnostics log, one row for each number of a row."""
    names = [n for n, k in rows.dtypes if n not in keys and k in ("double", "float", "int", "bigint", "smallint", "boolean")]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return rows.select(*keys, F.stack(F.lit(len(names)), *pairs).alias("name", "value"))
