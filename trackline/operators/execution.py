"""From weights to shares, and from share targets to trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_shares(targets: DataFrame, value: float, reserve: float = 0.0, min_weight: float = 0.0, min_notional: float = 0.0, lot: float = 1.0, fractional: bool = False, by: str = "date", rounding: str = "floor") -> DataFrame:
    """by, asset, price, shares, cash: targets (by, asset, weight, price) bought with `value` less the reserve.

    Small weights and positions are dropped, each time scaling the rest; shares are whole lots, rounded
    down, so that the budget is never exceeded, or with rounding="round" to the nearest lot, halves to even ones, so that
    cash may be negative. `cash` is what is left of the value.
    """
    if rounding not in ("floor", "round"):
        raise ValueError(f"no such rounding: {rounding}")
    day = Window.partitionBy(by)
    w = F.when((F.col("weight") >= min_weight) & (F.col("price") > 0), F.col("weight")).otherwise(0.0)
    rows = targets.withColumn("_w", w).withColumn("_w", F.coalesce(F.try_divide("_w", F.sum("_w").over(day)), F.lit(0.0)))
    budget = value * (1 - reserve)
    rows = rows.withColumn("_n", F.when(F.col("_w") * budget >= min_notional, F.col("_w") * budget).otherwise(0.0))
    rows = rows.withColumn("_n", F.coalesce(F.try_divide("_n", F.sum("_n").over(day)), F.lit(0.0)) * budget)
    raw = F.coalesce(F.try_divide("_n", "price"), F.lit(0.0))
    lots = F.floor(raw / lot) if rounding == "floor" else F.bround(raw / lot)
    shares = raw if fractional else lots.cast("double") * lot
    rows = rows.withColumn("shares", F.greatest(shares, F.lit(0.0)))
    return rows.select(by, "asset", "price", "shares", (F.lit(value) - F.sum(F.col("shares") * F.coalesce("price", F.lit(0.0))).over(day)).alias("cash"))


def orders(current: DataFrame, target: DataFrame, cash: DataFrame, min_notional: float = 0.0, by: str = "date") -> DataFrame:
    """by, asset, qty_delta, price, notional, side: the trades from current (by, asset, shares) to target (by,
    asset, price, shares). Small trades are left; if cash (by, cash) and sales do not pay for the purchases,
    these are scaled down to whole shares."""
    both = target.select(by, "asset", "price", "shares").join(current.select(by, "asset", F.col("shares").alias("_c")), [by, "asset"], "full")
    rows = both.withColumn("_d", F.coalesce("shares", F.lit(0.0)) - F.coalesce("_c", F.lit(0.0)))
    rows = rows.filter((F.col("price") > 0) & (F.col("_d") != 0) & (F.abs(F.col("_d") * F.col("price")) >= min_notional))
    day = Window.partitionBy(by)
    buys = F.sum(F.greatest(F.col("_d"), F.lit(0.0)) * F.col("price")).over(day)
    sales = F.sum(F.greatest(-F.col("_d"), F.lit(0.0)) * F.col("price")).over(day)
    rows = rows.join(cash.select(by, "cash"), by).withColumn("_k", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("cash") + sales, buys), F.lit(1.0)))))
    qty = F.when((F.col("_d") > 0) & (F.col("_k") < 1), F.floor(F.col("_d") * F.col("_k")).cast("double")).otherwise(F.col("_d"))
    rows = rows.withColumn("qty_delta", qty).filter("qty_delta <> 0")
    return rows.select(by, "asset", "qty_delta", "price", (F.col("qty_delta") * F.col("price")).alias("notional"), F.when(F.col("qty_delta") > 0, "BUY").otherwise("SELL").alias("side"))
