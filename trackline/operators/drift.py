"""Buy-and-hold paths between rebalances, in closed form.

Within a segment an asset grows by G = product(1 + r); weights at a date are w0 G / sum(w0 G) and the
portfolio's value is V = sum(w0 G), so no loop over days is needed. Segments of one path are chained by
their weights only, which targets replace, so all segments of all paths run in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.operators.calendars import valid_ranges


def drift(returns: DataFrame, targets: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., date, asset, segment, ret, w_in_force (before the date's return), w_close (after it).

    targets: by..., rebal_date, asset, weight, held from the close of rebal_date: the first return they earn is
    the next date's. Missing returns count as zero.
    """
    spans = valid_ranges(targets.select(*by, "rebal_date").distinct(), by, "rebal_date")
    held = targets.filter("weight <> 0").join(spans, [*by, "rebal_date"])
    r = returns.select("date", F.col("asset").alias("_a"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    on = (F.col("asset") == F.col("_a")) & (F.col("date") > F.col("rebal_date")) & (F.col("until").isNull() | (F.col("date") <= F.col("until")))
    rows = held.join(r, on).drop("_a", "until").withColumnRenamed("rebal_date", "segment")
    path = Window.partitionBy(*by, "segment", "asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.col("weight") * F.product(1 + F.col("ret")).over(path))
    rows = rows.withColumn("_b", F.col("_g") / (1 + F.col("ret")))
    rows = rows.withColumn("_b", F.when(1 + F.col("ret") == 0, F.lit(None)).otherwise(F.col("_b")))
    day = Window.partitionBy(*by, "date")
    return rows.select(*by, "date", "asset", "segment", "ret", (F.col("_b") / F.sum("_b").over(day)).alias("w_in_force"), (F.col("_g") / F.sum("_g").over(day)).alias("w_close"))


def path_return(path: DataFrame, name: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    return path.groupBy(*by, "date").agg(F.sum(F.col("w_in_force") * F.col("ret")).alias(name))


def cost_fraction(path: DataFrame, targets: DataFrame, bps: float, fixed: float = 0.0, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., date, cost: basis points of the weights that change at each rebalance, and a fixed part."""
    before = path.select(*by, "date", "asset", (-F.col("w_close")).alias("w"))
    dates = before.select(*by, "date").distinct()
    after = targets.select(*by, F.col("rebal_date").alias("date"), "asset", F.col("weight").alias("w"))
    at = dates.join(after.select(*by, "date").distinct(), [*by, "date"])
    both = before.unionByName(after).join(at, [*by, "date"], "left_semi")
    change = both.groupBy(*by, "date", "asset").agg(F.abs(F.sum("w")).alias("d"))
    return change.groupBy(*by, "date").agg(F.greatest(F.sum("d") * (bps / 1e4) + fixed, F.lit(0.0)).alias("cost"))
