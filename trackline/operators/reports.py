"""The tables behind the reports: calibration, attribution, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.operators.calendars import valid_ranges


def realised_variance(series: DataFrame, rebalances: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., rebal_date, n, var_post: the variance of a return between rebalances, [t, next); for fewer than
    five dates the squared compounded return over their number."""
    spans = valid_ranges(rebalances.select(*by, "rebal_date").distinct(), by, "rebal_date")
    on = (F.col("date") >= F.col("rebal_date")) & (F.col("until").isNull() | (F.col("date") < F.col("until")))
    s = series.withColumnsRenamed({b: f"_{b}" for b in by})
    for b in by:
        on = on & (F.col(b) == F.col(f"_{b}"))
    rows = spans.join(s, on)
    n, r = F.count(value), F.product(1 + F.col(value)) - 1
    return rows.groupBy(*by, "rebal_date").agg(n.alias("n"), F.when(n >= 5, F.var_samp(value)).otherwise(r * r / n).alias("var_post"))


def calibration(ante: DataFrame, post: DataFrame, ann: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., n, mean_ratio, std_ratio, below, above, bias_ann from var_ante and var_post by rebalance."""
    rows = ante.join(post, [*by, "rebal_date"]).withColumn("ratio", F.try_divide("var_ante", "var_post")).filter("ratio IS NOT NULL")
    part = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio"), F.stddev_samp("ratio").alias("std_ratio"), part(F.col("ratio") < 1).alias("below"), part(F.col("ratio") > 1).alias("above"), (F.avg(F.col("var_ante") - F.col("var_post")) * ann).alias("bias_ann"))


def _sector_days(path: DataFrame, returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """date, sector, wp, wb, rp, rb: weights and returns within each sector. path: date, asset, wp, wb."""
    rows = path.join(returns.select("date", "asset", F.coalesce("ret", F.lit(0.0)).alias("ret")), ["date", "asset"]).join(F.broadcast(sectors), "asset")
    part = lambda w: F.coalesce(F.try_divide(F.sum(F.col(w) * F.col("ret")), F.sum(w)), F.lit(0.0))
    return rows.groupBy("date", "sector").agg(F.sum("wp").alias("wp"), F.sum("wb").alias("wb"), part("wp").alias("rp"), part("wb").alias("rb"))


def sector_attribution(path: DataFrame, returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """sector, mean weights, compounded sector returns, contributions (their products), and a TOTAL row whose
    returns are those of the whole portfolio and benchmark."""
    days = _sector_days(path, returns, sectors)
    grown = lambda r: F.product(1 + F.col(r)) - 1
    by_sector = days.groupBy("sector").agg(F.avg("wp").alias("w_port"), F.avg("wb").alias("w_bench"), grown("rp").alias("r_port"), grown("rb").alias("r_bench"))
    by_sector = by_sector.withColumns({"c_port": F.col("w_port") * F.col("r_port"), "c_bench": F.col("w_bench") * F.col("r_bench")})
    whole = days.groupBy("date").agg(F.sum(F.col("wp") * F.col("rp")).alias("rp"), F.sum(F.col("wb") * F.col("rb")).alias("rb")).agg(grown("rp").alias("r_port"), grown("rb").alias("r_bench"))
    sums = by_sector.agg(*[F.sum(c).alias(c) for c in ("w_port", "w_bench", "c_port", "c_bench")])
    total = sums.crossJoin(F.broadcast(whole)).withColumn("sector", F.lit("TOTAL"))
    out = by_sector.unionByName(total)
    return out.withColumns({"w_active": F.col("w_port") - F.col("w_bench"), "c_active": F.col("c_port") - F.col("c_bench")})


def brinson(path: DataFrame, returns: DataFrame, sectors: DataFrame, linking: str = "compound") -> DataFrame:
    """sector, allocation, selection, interaction, linked over dates: by the returns compounded before and after
    (compound), or by ratios of total to running growth (ratio)."""
    days = _sector_days(path, returns, sectors)
    whole = days.groupBy("date").agg(F.sum(F.col("wp") * F.col("rp")).alias("tp"), F.sum(F.col("wb") * F.col("rb")).alias("tb"))
    # One row a date: a narrow table, so its windows need no partition.
    w = Window.orderBy("date")
    before = F.coalesce(F.product(1 + F.col("tp")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    after = F.coalesce(F.product(1 + F.col("tb")).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))
    if linking == "ratio":
        from trackline.operators.events import ratio_links

        rows = days.join(whole.join(ratio_links(whole), "date"), "date")
    else:
        rows = days.join(whole.withColumn("link", before * after), "date")
    effect = {"allocation": (F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("tb")), "selection": F.col("wb") * (F.col("rp") - F.col("rb")), "interaction": (F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))}
    return rows.groupBy("sector").agg(*[F.sum(F.col("link") * e).alias(n) for n, e in effect.items()])


def active_weights(port: DataFrame, bench: DataFrame) -> DataFrame:
    """rebal_date, asset, ptf_weight, bench_weight, active_weight for all assets of either side."""
    p = port.select("rebal_date", "asset", F.col("weight").alias("ptf_weight"))
    out = p.join(bench.select("rebal_date", "asset", F.col("weight").alias("bench_weight")), ["rebal_date", "asset"], "full").na.fill(0.0, ["ptf_weight", "bench_weight"])
    return out.withColumn("active_weight", F.col("ptf_weight") - F.col("bench_weight"))


def inventory(path: DataFrame, rebalances: DataFrame, cal: DataFrame, lag: int = 1, name: str = "portfolio") -> DataFrame:
    """ptf_name, rebal_date, asset, weight: the weights in force `lag` trading dates after each rebalance, or on
    the calendar's last date, or, if that has none, on the latest one before."""
    last = cal.agg(F.max("idx").alias("_last"))
    at = rebalances.select("rebal_date").distinct().join(cal, F.col("rebal_date") == F.col("date")).crossJoin(F.broadcast(last)).select("rebal_date", F.least(F.col("idx") + lag, F.col("_last")).alias("_to"))
    days = path.select("date").distinct().join(cal, "date").select(F.col("date").alias("_d"), "idx")
    found = at.join(F.broadcast(days), F.col("idx") <= F.col("_to")).groupBy("rebal_date").agg(F.max("_d").alias("date"))
    return path.join(found, "date").filter("weight <> 0").select(F.lit(name).alias("ptf_name"), "rebal_date", "asset", "weight")


def allocation_stats(active: DataFrame) -> DataFrame:
    """One row a rebalance: counts, turnover, active share, concentration, extremes, and top three on each side."""
    day = Window.partitionBy("rebal_date")
    rows = active.withColumns({"_o": F.row_number().over(day.orderBy(F.desc("active_weight"), "asset")), "_u": F.row_number().over(day.orderBy("active_weight", "asset"))})
    told = F.format_string("%s %+.2f%%", "asset", F.col("active_weight") * 100)
    top = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(k) <= 3, F.struct(k, told.alias("s"))))), lambda x: x["s"]), ", ")
    pick = lambda k, c: F.max(F.when(F.col(k) == 1, F.col(c)))
    out = rows.groupBy("rebal_date").agg(
        F.count_if(F.col("ptf_weight") > 0).alias("n_positions"), F.count_if((F.col("bench_weight") > 0) & (F.col("ptf_weight") <= 0)).alias("n_excluded"),
        (F.sum(F.abs("active_weight")) / 2).alias("active_share"), F.sum("ptf_weight").alias("sum_ptf"), F.sum("bench_weight").alias("sum_bench"),
        F.sum(F.col("ptf_weight") * F.col("ptf_weight")).alias("hhi_ptf"), F.sum(F.col("bench_weight") * F.col("bench_weight")).alias("hhi_bench"),
        pick("_o", "asset").alias("max_over_ticker"), pick("_o", "active_weight").alias("max_over_weight"), pick("_u", "asset").alias("max_under_ticker"), pick("_u", "active_weight").alias("max_under_weight"),
        top("_o").alias("top3_over"), top("_u").alias("top3_under"),
    )
    from trackline.operators.evaluate import turnover

    moved = turnover(active.select(F.col("rebal_date").alias("date"), "asset", F.col("ptf_weight").alias("weight")))
    return out.join(moved.withColumnRenamed("date", "rebal_date"), "rebal_date", "left")
