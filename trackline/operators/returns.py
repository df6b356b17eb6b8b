"""From prices to clean return panels, in long form: date, asset, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _path() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("date")


def densify(panel: DataFrame) -> DataFrame:
    """One row for every date and asset that occur; what the panel lacks is null.

    The dense panel is the result asked for: a date counts all assets, an asset all dates.
    """
    return panel.select("date").distinct().crossJoin(panel.select("asset").distinct()).join(panel, ["date", "asset"], "left")


def forward_fill(panel: DataFrame, value: str = "price") -> DataFrame:
    return panel.withColumn(value, F.last(value, ignorenulls=True).over(_path().rowsBetween(Window.unboundedPreceding, 0)))


def arithmetic(panel: DataFrame, periods: int = 1, fill: bool = True) -> DataFrame:
    """date, asset, ret = price / earlier price - 1; gaps carry the last price forward if `fill`."""
    panel = forward_fill(panel) if fill else panel
    before = F.lag("price", periods).over(_path())
    return panel.select("date", "asset", (F.try_divide("price", before) - 1).alias("ret"))


def logarithmic(panel: DataFrame, periods: int = 1) -> DataFrame:
    """date, asset, ret = log of the price ratio where both prices are positive, else null."""
    before = F.lag("price", periods).over(_path())
    return panel.select("date", "asset", F.when((F.col("price") > 0) & (before > 0), F.log(F.col("price") / before)).alias("ret"))


def drop_mostly_zero(returns: DataFrame, ratio: float = 0.975, tolerance: float = 0.0) -> DataFrame:
    """Drop dates, then assets, whose share of zero or missing returns reaches the ratio."""
    zero = F.when(F.coalesce(F.abs("ret"), F.lit(0.0)) <= tolerance, 1.0).otherwise(0.0)
    out = returns.withColumn("_z", F.avg(zero).over(Window.partitionBy("date"))).filter(F.col("_z") < ratio)
    return out.withColumn("_z", F.avg(zero).over(Window.partitionBy("asset"))).filter(F.col("_z") < ratio).drop("_z")


def drop_all_zero(returns: DataFrame, value: str = "ret", tolerance: float = 0.0) -> DataFrame:
    """Drop dates, then assets, that hold nothing but zeros and nulls."""
    some = F.max(F.abs(value))
    dates = returns.groupBy("date").agg(some.alias("m")).filter(F.col("m") > tolerance).select("date")
    out = returns.join(dates, "date", "left_semi")
    assets = out.groupBy("asset").agg(some.alias("m")).filter(F.col("m") > tolerance).select("asset")
    return out.join(assets, "asset", "left_semi")


def compound(returns: DataFrame, bucket: Column) -> DataFrame:
    """Compounded returns of calendar buckets; missing returns count as zero."""
    return returns.groupBy(bucket.alias("date"), "asset").agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))


def week_ending_friday(date: str = "date") -> Column:
    return F.next_day(F.date_sub(date, 1), "FR")


def coverage(returns: DataFrame, min_coverage: float, min_obs: int) -> DataFrame:
    """asset, n_obs, covered: whether enough of the dates have a return."""
    days = returns.select("date").distinct().agg(F.count("*").alias("days"))
    out = returns.groupBy("asset").agg(F.count("ret").alias("n_obs")).crossJoin(F.broadcast(days))
    return out.select("asset", "n_obs", ((F.col("n_obs") >= min_obs) & (F.col("n_obs") / F.col("days") >= min_coverage)).alias("covered"))


def union_prices(*panels: DataFrame) -> DataFrame:
    """Later panels win where several hold a date and asset; nulls never do."""
    parts = [p.select("date", "asset", "price", F.lit(k).alias("_seq")) for k, p in enumerate(panels)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("price IS NOT NULL").groupBy("date", "asset").agg(F.max_by("price", "_seq").alias("price"))
