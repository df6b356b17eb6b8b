"""Covariance estimators that are aggregates of pairs: rolling, EWMA, linear shrinkage, OAS.

Each takes dense windows in long form, date, asset, ret, and any keys in `by` (a rebalance date, a model),
and gives by..., i, j, cov for i <= j. A missing return counts as zero and an asset without any other
return in the window is left out. Pairs of N assets over T dates are T N (N + 1) / 2 rows: fit for tens of
assets; for hundreds use the packed kernels of trackline.functions.kernels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windows(returns: DataFrame, cal: DataFrame, at: DataFrame, length: int, lag: int = 0) -> DataFrame:
    """rebal_date, date, asset, ret, t (1 to length): the rows of the `length` dates that end `lag` before each
    rebalance date that has so many."""
    ends = at.join(cal, at["rebal_date"] == cal["date"]).select("rebal_date", (F.col("idx") - lag).alias("_end")).filter(F.col("_end") >= length - 1)
    days = ends.select("rebal_date", "_end", F.explode(F.sequence(F.col("_end") - length + 1, F.col("_end"))).alias("idx"))
    days = days.join(cal, "idx").select("rebal_date", "date", (F.col("idx") - F.col("_end") + length).alias("t"))
    return returns.join(days, "date").select("rebal_date", "date", "asset", F.coalesce("ret", F.lit(0.0)).alias("ret"), "t")


def active(window: DataFrame, by: list[str]) -> DataFrame:
    return window.withColumn("_m", F.max(F.abs("ret")).over(Window.partitionBy(*by, "asset"))).filter("_m > 0").drop("_m")


def pairs(window: DataFrame, by: list[str]) -> DataFrame:
    """by..., date, i, j, ri, rj for i <= j."""
    x = window.select(*by, "date", F.col("asset").alias("i"), F.col("ret").alias("ri"))
    y = window.select(*by, "date", F.col("asset").alias("j"), F.col("ret").alias("rj"))
    return x.join(y, [*by, "date"]).filter("i <= j")


def rolling(window: DataFrame, by: list[str], ddof: int = 1) -> DataFrame:
    agg = F.covar_samp if ddof else F.covar_pop
    return pairs(active(window, by), by).groupBy(*by, "i", "j").agg(agg("ri", "rj").alias("cov"))


def ewma(returns: DataFrame, cal: DataFrame, decay: float, start: int) -> DataFrame:
    """i, j, cov at the calendar's last date: decay^m S0 + (1 - decay) sum decay^(T - t) r r'.

    S0 is the sample covariance of the first `start` dates. A date counts for its pairs if two assets or more
    have a return other than zero. The recursion has a closed form for a constant decay.
    """
    rows = returns.join(cal, "date").select("date", "asset", F.coalesce("ret", F.lit(0.0)).alias("ret"), "idx")
    last = cal.agg(F.max("idx").alias("last"))
    busy = F.sum(F.when(F.col("ret") != 0, 1).otherwise(0)).over(Window.partitionBy("date"))
    rows = rows.withColumn("_busy", busy).crossJoin(F.broadcast(last))
    x = rows.select("date", "idx", "last", "_busy", F.col("asset").alias("i"), F.col("ret").alias("ri"))
    y = rows.select("date", F.col("asset").alias("j"), F.col("ret").alias("rj"))
    p = x.join(y, "date").filter("i <= j")
    early, late = F.col("idx") < start, (F.col("idx") >= start) & (F.col("_busy") >= 2)
    shock = F.sum(F.when(late, F.pow(F.lit(decay), F.col("last") - F.col("idx")) * F.col("ri") * F.col("rj")).otherwise(0.0))
    seed = F.covar_samp(F.when(early, F.col("ri")), F.when(early, F.col("rj")))
    return p.groupBy("i", "j").agg((F.pow(F.lit(decay), F.max("last") - start + 1) * seed + (1 - decay) * shock).alias("cov"))


def _moments(window: DataFrame, by: list[str]) -> DataFrame:
    """by..., i, j, s (population covariance), p (assets), n (dates), trace mean, squares of s over all pairs, and
    the sum of fourth powers of the centred rows' norms."""
    w = active(window, by)
    w = w.withColumn("_c", F.col("ret") - F.avg("ret").over(Window.partitionBy(*by, "asset")))
    norms = w.groupBy(*by, "date").agg(F.sum(F.col("_c") * F.col("_c")).alias("q")).groupBy(*by).agg(F.sum(F.col("q") * F.col("q")).alias("x4"), F.count("*").alias("n"))
    s = pairs(w, by).groupBy(*by, "i", "j").agg(F.covar_pop("ri", "rj").alias("s"))
    on_diagonal = F.when(F.col("i") == F.col("j"), F.col("s"))
    both = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    whole = s.groupBy(*by).agg(F.count(on_diagonal).alias("p"), F.avg(on_diagonal).alias("m"), F.sum(F.col("s") * F.col("s") * both).alias("ss"))
    return s.join(whole.join(norms, by), by) if by else s.crossJoin(F.broadcast(whole.crossJoin(norms)))


def _shrunk(moments: DataFrame, rho, by: list[str]) -> DataFrame:
    target = F.when(F.col("i") == F.col("j"), F.col("m")).otherwise(0.0)
    return moments.withColumn("rho", rho).select(*by, "i", "j", (F.col("rho") * target + (1 - F.col("rho")) * F.col("s")).alias("cov"), "rho")


def ledoit_wolf(window: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Shrinkage to a scaled identity (Ledoit and Wolf 2004), population covariances of centred returns."""
    d2 = F.col("ss") - F.col("p") * F.col("m") * F.col("m")
    b2 = F.greatest((F.col("x4") - F.col("n") * F.col("ss")) / (F.col("n") * F.col("n")), F.lit(0.0))
    rho = F.when(d2 <= 1e-24, 1.0).otherwise(F.greatest(F.least(F.try_divide(b2, d2), F.lit(1.0)), F.lit(0.0)))
    return _shrunk(_moments(window, by), rho, by)


def oas(window: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Oracle approximating shrinkage (Chen, Wiesel, Eldar and Hero 2010)."""
    alpha = F.col("ss") / (F.col("p") * F.col("p"))
    num, den = alpha + F.col("m") * F.col("m"), (F.col("n") + 1) * (alpha - F.col("m") * F.col("m") / F.col("p"))
    rho = F.when(den <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(num, den)))
    return _shrunk(_moments(window, by), rho, by)


def with_benchmark(window: DataFrame, bench: DataFrame, least: int = 10) -> DataFrame:
    """asset, cov_ib: sample covariance with the benchmark's return (date, bench_ret)."""
    rows = window.join(bench, "date").filter("ret IS NOT NULL AND bench_ret IS NOT NULL")
    return rows.groupBy("asset").agg(F.covar_samp("ret", "bench_ret").alias("cov_ib"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")


def quadratic(cov: DataFrame, vector: DataFrame, by: list[str] = [], value: str = "a") -> DataFrame:  # noqa: B006
    """by..., variance = v' cov v, from the upper triangle and by..., asset, `value`."""
    x = vector.select(*by, F.col("asset").alias("i"), F.col(value).alias("_x"))
    y = vector.select(*by, F.col("asset").alias("j"), F.col(value).alias("_y"))
    both = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return cov.join(x, [*by, "i"]).join(y, [*by, "j"]).groupBy(*by).agg(F.sum(both * F.col("_x") * F.col("_y") * F.col("cov")).alias("variance"))


def frobenius(one: DataFrame, other: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., frobenius: the norm of the difference of two covariance tables; an absent pair is zero."""
    both = one.select(*by, "i", "j", "cov").join(other.select(*by, "i", "j", F.col("cov").alias("_o")), [*by, "i", "j"], "full")
    d = F.coalesce("cov", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0))
    times = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return both.groupBy(*by).agg(F.sqrt(F.sum(times * d * d)).alias("frobenius"))


def mean_loss(losses: DataFrame, value: str, burn_in: int) -> DataFrame:
    """n, `value`_mean: the mean of a loss (rebal_date, value) over dates but the first `burn_in`."""
    rows = losses.withColumn("_k", F.row_number().over(Window.orderBy("rebal_date"))).filter(F.col("_k") > burn_in)
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias(f"{value}_mean"))


def held_out_losses(one: DataFrame, other: DataFrame, parts: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., seed, frobenius, largest: how far two covariance tables are apart if the assets of one part are left out.

    parts: asset, part. Each part is left out once, as `seed`. Differences are summed up by the parts of both assets
    first, so what meets the seeds are squares of the number of parts. An absent pair is zero; an asset without a part is
    never left out; a seed that leaves no pair has no row."""
    both = one.select(*by, "i", "j", "cov").join(other.select(*by, "i", "j", F.col("cov").alias("_o")), [*by, "i", "j"], "full")
    d = F.coalesce("cov", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0))
    # A universe has hundreds of names.
    for side in "ij":
        both = both.join(F.broadcast(parts.select(F.col("asset").alias(side), F.col("part").alias(f"_{side}"))), side, "left")
    square = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * d * d
    cells = both.groupBy(*by, "_i", "_j").agg(F.sum(square).alias("_s"), F.max(F.abs(d)).alias("_m"))
    seeds = F.broadcast(parts.select(F.col("part").alias("seed")).distinct())
    left = ~(F.col("_i").eqNullSafe(F.col("seed")) | F.col("_j").eqNullSafe(F.col("seed")))
    return cells.join(seeds, left).groupBy(*by, "seed").agg(F.sqrt(F.sum("_s")).alias("frobenius"), F.max("_m").alias("largest"))


def over_seeds(losses: DataFrame, metrics: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., metric, n, mean, std of each metric over the seeds, of one row a seed. Nulls and NaN are left out; the
    deviation of one value is zero, that of none null, as is its mean."""
    rows = losses.unpivot([F.col(c) for c in by], metrics, "metric", "value")
    real = F.when(~F.isnan("value"), F.col("value"))
    std = F.when(F.count(real) > 0, F.coalesce(F.stddev_samp(real), F.lit(0.0)))
    return rows.groupBy(*by, "metric").agg(F.count(real).alias("n"), F.avg(real).alias("mean"), std.alias("std"))
