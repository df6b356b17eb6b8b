"""Allocations that need no solver: benchmark redistribution, inverse volatility, core and satellite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("global_prop", "global_inv", "sector_prop", "sector_inv")


def redistribute(bench: DataFrame, excluded: DataFrame, mode: str, threshold: float = 1.0, by: str = "date") -> DataFrame:
    """by, asset, weight: the benchmark (by, asset, sector, weight) without the excluded assets.

    Weights of at least `threshold` stay as they are. What is left of the budget goes to the other kept
    assets in proportion to their weights, or to the inverse of these; in the sector modes each sector
    keeps its own budget, and that of a sector without such an asset is spread over the others pro rata.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    rows = bench.join(F.broadcast(excluded.select("asset", F.lit(True).alias("_x"))), "asset", "left").withColumn("_x", F.coalesce("_x", F.lit(False)) | (F.col("weight") <= 0))
    rows = rows.withColumn("_f", ~F.col("_x") & (F.col("weight") >= threshold))
    free = ~F.col("_x") & ~F.col("_f")
    score = F.when(free, F.col("weight") if mode.endswith("prop") else 1 / F.col("weight")).otherwise(0.0)
    rows = rows.withColumn("_s", score)
    day, sector = Window.partitionBy(by), Window.partitionBy(by, "sector")
    frozen = F.when(F.col("_f"), F.col("weight")).otherwise(0.0)
    budget = F.sum("weight").over(day) - F.sum(frozen).over(day)
    if mode.startswith("global"):
        share = F.try_divide("_s", F.sum("_s").over(day))
    else:
        rows = rows.withColumns({"_own": F.sum("weight").over(sector) - F.sum(frozen).over(sector), "_t": F.sum("_s").over(sector)})
        live = F.when(F.col("_t") > 0, F.col("weight") - frozen).otherwise(0.0)
        rows = rows.withColumn("_live", F.sum(live).over(day))
        share = F.when(F.col("_t") > 0, F.try_divide(F.col("_own"), F.col("_live")) * F.col("_s") / F.col("_t")).otherwise(0.0)
    out = rows.withColumn("w", F.when(F.col("_f"), F.col("weight")).otherwise(F.coalesce(budget * share, F.lit(0.0))))
    return out.select(by, "asset", F.col("w").alias("weight"))


def core_weights(bench: DataFrame, excluded: DataFrame, mode: str, budget: float = 1.0, threshold: float | None = None, by: str = "date", eps: float = 1e-12) -> DataFrame:
    """by, asset, weight, frozen: the core of a portfolio, `budget` in all, from the benchmark (by, asset, sector, weight).

    Every asset's goal is its benchmark weight times the budget; without any weight on a date all assets are equal.
    Excluded assets get nothing. Weights of at least `threshold` are frozen at their goal, and the rest of the budget goes to
    the other assets, the open ones:

    * global modes: in proportion to their weights, or to the inverse of these;
    * sector modes: each sector keeps its goal less what is frozen in it; what sectors without open assets leave is
      spread over the others in proportion to theirs, or by the global rule if there are none. If the sum then misses the
      budget, as with a benchmark that doesn't sum to one, what is not frozen is scaled to it.

    Open assets without any score share equally. If the frozen goals exceed the budget, they are scaled down to it and the
    other assets keep their goals; if nothing is left to give, or nothing is open, all keep theirs.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    budget = min(max(budget, 0.0), 1.0)
    day, sector = Window.partitionBy(by), Window.partitionBy(by, "sector")
    rows = bench.select(by, "asset", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"), F.coalesce("weight", F.lit(0.0)).alias("_w"))
    rows = rows.join(excluded.select("asset", F.lit(True).alias("_x")).distinct(), "asset", "left").withColumn("_x", F.coalesce("_x", F.lit(False)))
    whole = F.sum("_w").over(day)
    rows = rows.withColumn("_w", F.when(whole <= eps, 1 / F.count("*").over(day)).otherwise(F.col("_w")))
    frozen = ~F.col("_x") & (F.col("_w") >= threshold) if threshold and threshold > 0 else F.lit(False)
    rows = rows.withColumns({"_f": frozen, "_goal": F.when(F.col("_x"), 0.0).otherwise(F.col("_w") * budget)}).withColumn("_open", ~F.col("_x") & ~F.col("_f"))
    held = F.when(F.col("_f"), F.col("_goal")).otherwise(0.0)
    score = F.greatest("_w", F.lit(0.0)) if mode.endswith("prop") else 1 / F.greatest("_w", F.lit(eps))
    rows = rows.withColumns({
        "_s": F.when(F.col("_open"), score).otherwise(0.0), "_held": F.sum(held).over(day), "_n": F.count_if("_open").over(day), "_k": F.count_if("_open").over(sector),
        "_own": F.sum("_w").over(sector) * budget - F.sum(held).over(sector), "_first": F.row_number().over(sector.orderBy("asset")) == 1,
    }).withColumns({"_rest": budget - F.col("_held"), "_day_score": F.sum("_s").over(day), "_sector_score": F.sum("_s").over(sector)})

    def share(score, of, n):
        return F.when(of > eps, score / of).otherwise(1 / n)

    everywhere = F.col("_rest") * share(F.col("_s"), F.col("_day_score"), F.col("_n"))
    give = F.when((F.col("_rest") > eps) & F.col("_open"), everywhere).otherwise(F.col("_goal"))
    if mode.startswith("sector"):
        once = lambda c: F.sum(F.when(F.col("_first") & (F.col("_own") > eps) & c, F.col("_own")).otherwise(0.0)).over(day)
        rows = rows.withColumns({"_spill": once(F.col("_k") == 0), "_live": once(F.col("_k") > 0)})
        spread = F.when(F.col("_spill") > eps, F.col("_own") * (1 + F.col("_spill") / F.col("_live"))).otherwise(F.col("_own"))
        inside = F.when(F.col("_own") > eps, spread * share(F.col("_s"), F.col("_sector_score"), F.col("_k"))).otherwise(F.col("_goal"))
        nowhere = (F.col("_spill") > eps) & (F.col("_live") <= eps)
        rows = rows.withColumns({"_global": nowhere, "_given": F.when(F.col("_open"), inside).otherwise(F.col("_goal"))})
        rows = rows.withColumns({"_all": F.sum("_given").over(day), "_loose": F.sum(F.when(~F.col("_f"), F.col("_given")).otherwise(0.0)).over(day)})
        off = (F.abs(F.col("_all") - budget) > 1e-8) & (F.col("_all") > eps) & (F.col("_loose") > eps) & ~F.col("_f")
        scaled = F.when(off, F.col("_given") * F.when(F.col("_rest") > -eps, F.col("_rest") / F.col("_loose")).otherwise(0.0)).otherwise(F.col("_given"))
        give = F.when((F.col("_rest") <= eps) | (F.col("_n") == 0), F.col("_goal")).otherwise(F.when(nowhere, give).otherwise(scaled))
    over = F.when(F.col("_f"), F.when(F.col("_held") > eps, F.col("_goal") / F.col("_held") * budget).otherwise(0.0)).otherwise(F.when(F.col("_held") > eps, F.col("_goal")).otherwise(0.0))
    return rows.select(by, "asset", F.when(F.col("_rest") < -1e-10, over).otherwise(give).alias("weight"), F.col("_f").alias("frozen"))


def inverse_volatility(window: DataFrame, sectors: DataFrame, by: list[str], sector_power: float = 1.0, asset_power: float = 1.0, floor: float = 1e-6, least: int = 10, cap: float | None = None) -> DataFrame:
    """by..., asset, weight: sectors by the inverse of their mean volatility, assets within them by theirs.

    An asset without volatility gets none; with fewer than `least` dates all assets are equal. `cap` clips
    once and scales again.
    """
    vol = window.groupBy(*by, "asset").agg(F.stddev_samp("ret").alias("v"), F.count("*").alias("n")).join(F.broadcast(sectors), "asset")
    vol = vol.withColumn("v", F.when(F.col("v") > 0, F.col("v")))
    day, own = Window.partitionBy(*by), Window.partitionBy(*by, "sector")
    vol = vol.withColumns({"_s": F.pow(1 / F.avg("v").over(own), F.lit(sector_power)), "_a": F.pow(1 / F.greatest("v", F.lit(floor)), F.lit(asset_power)), "_k": F.row_number().over(own.orderBy("asset"))})
    total = F.sum(F.when(F.col("_k") == 1, F.col("_s"))).over(day)
    w = F.when(F.max("n").over(day) < least, 1 / F.count("*").over(day)).otherwise(F.coalesce(F.col("_s") / total * F.col("_a") / F.sum("_a").over(own), F.lit(0.0)))
    out = vol.withColumn("weight", w)
    if cap is not None:
        out = out.withColumn("weight", F.least("weight", F.lit(cap)))
    return out.select(*by, "asset", (F.col("weight") / F.sum("weight").over(day)).alias("weight"))


def blend(core: DataFrame, satellite: DataFrame, core_weight: float, by: str = "date") -> DataFrame:
    """core_weight of one and the rest of the other, scaled to one."""
    both = core.select(by, "asset", (F.col("weight") * core_weight).alias("weight")).union(satellite.select(by, "asset", (F.col("weight") * (1 - core_weight)).alias("weight")))
    both = both.groupBy(by, "asset").agg(F.sum("weight").alias("weight"))
    return both.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy(by)))
