"""Moments and their sampling errors as aggregates and column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.functions import normal, ranks
from trackline.sources.shared import stored


def empirical(df: DataFrame, value: str, by: list[str], ddof: int = 1, fisher: bool = False) -> DataFrame:
    """by..., n, mean, var, skew, kurt: population skew and kurtosis (less three if `fisher`)."""
    var = F.var_samp(value) if ddof else F.var_pop(value)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), var.alias("var"), F.skewness(value).alias("skew"), (F.kurtosis(value) + (0 if fisher else 3)).alias("kurt"))


def mean_error(df: DataFrame, value: str, by: list[str], level: float = 0.95, null: float = 0.0) -> DataFrame:
    """by..., mean, se, low, high, z: the mean's standard error, interval and z against `null`."""
    q = NormalDist().inv_cdf((1 + level) / 2)
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    return out.withColumns({"low": F.col("mean") - q * F.col("se"), "high": F.col("mean") + q * F.col("se"), "z": F.try_divide(F.col("mean") - null, F.col("se"))})


def variance_error(variance: Column, n: Column) -> Column:
    """Standard error of a Gaussian variance estimate."""
    return F.sqrt(2 * variance * variance / n)


def needed_dates(variance: Column, target: float) -> Column:
    """Dates until the mean's standard error reaches a target."""
    return F.ceil(variance / (target * target))


def largest_means(df: DataFrame, value: str, by: list[str], k: int, level: float = 0.95) -> DataFrame:
    """by..., mean, low, high of the k means furthest from zero."""
    rows = mean_error(df, value, by, level).select(*by, "mean", "low", "high")
    return rows.orderBy(F.abs("mean").desc(), *by).limit(k)


def portfolio_errors(rows: DataFrame, target: float, level: float = 0.95) -> DataFrame:
    """Adds to n, mean and variance of portfolios: the errors of mean and variance, z, the variance's interval, and the
    dates needed until the mean's error is `target`."""
    q = NormalDist().inv_cdf((1 + level) / 2)
    rows = rows.withColumns({"se_mean": F.sqrt(F.col("variance") / F.col("n")), "se_variance": variance_error(F.col("variance"), F.col("n"))})
    return rows.withColumns({"z": F.try_divide("mean", "se_mean"), "low": F.greatest(F.col("variance") - q * F.col("se_variance"), F.lit(0.0)), "high": F.col("variance") + q * F.col("se_variance"), "needed": needed_dates(F.col("variance"), target)})


def histogram(df: DataFrame, value: str) -> DataFrame:
    """bin, low, high, n: bins of the width of Freedman and Diaconis."""
    q = df.filter(F.col(value).isNotNull()).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"), F.count("*").alias("m"), F.min(value).alias("a"), F.max(value).alias("b"))
    q = q.withColumn("w", 2 * (F.col("q3") - F.col("q1")) / F.cbrt("m"))
    q = q.withColumn("bins", F.when(F.col("w") > 0, F.greatest(F.ceil((F.col("b") - F.col("a")) / F.col("w")), F.lit(1))).otherwise(F.lit(1)))
    rows = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(q))
    width = (F.col("b") - F.col("a")) / F.col("bins")
    k = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("a"), width)), F.lit(0)), F.col("bins") - 1)
    return rows.groupBy(k.cast("long").alias("bin")).agg(F.min(F.col("a") + k * width).alias("low"), F.min(F.col("a") + (k + 1) * width).alias("high"), F.count("*").alias("n"))


def joint_mle(returns: DataFrame) -> DataFrame:
    """i, j, mean_i, mean_j, cov, n (i <= j): the Gaussian maximum likelihood over the n dates that have any return.

    A mean is that of the asset's own returns; a pair of which one is missing on some date has no covariance.
    """
    rows = returns.filter(F.col("ret").isNotNull()).select("date", "asset", "ret")
    n = rows.agg(F.count_distinct("date").alias("n"))
    x = rows.select("date", F.col("asset").alias("i"), F.col("ret").alias("ri"))
    y = rows.select("date", F.col("asset").alias("j"), F.col("ret").alias("rj"))
    pairs = x.join(y, "date").filter("i <= j").groupBy("i", "j").agg(F.covar_pop("ri", "rj").alias("cov"), F.count("*").alias("held")).crossJoin(F.broadcast(n))
    mean = rows.groupBy("asset").agg(F.avg("ret").alias("mean"))
    one, other = (mean.select(F.col("asset").alias(k), F.col("mean").alias(f"mean_{k}")) for k in "ij")
    return pairs.join(one, "i").join(other, "j").select("i", "j", "mean_i", "mean_j", F.when(F.col("held") == F.col("n"), F.col("cov")).alias("cov"), "n")


def projected_covariances(cov: DataFrame, portfolios: DataFrame, n: Column, level: float = 0.95) -> DataFrame:
    """p, q, covariance, se, low, high, n (p <= q): the covariance p' cov q of each pair of portfolios and its error over
    n dates of Gaussian returns, which is sqrt((p'cov p q'cov q + (p'cov q)^2) / n).

    cov: i, j (i <= j), cov and the columns of n; portfolios: portfolio, asset, a. Each pair of assets meets the
    holders of both, so rows are pairs of assets times pairs of portfolios, summed where they arise.
    """
    held = portfolios.filter("a <> 0").select("portfolio", "asset", "a")
    full = cov.select("i", "j", "cov", n.alias("n")).union(cov.filter("i <> j").select(F.col("j"), F.col("i"), "cov", n))
    left = held.select(F.col("portfolio").alias("p"), F.col("asset").alias("i"), F.col("a").alias("x"))
    right = held.select(F.col("portfolio").alias("q"), F.col("asset").alias("j"), F.col("a").alias("y"))
    # First p' cov, a row for each portfolio and asset; then its product with each q.
    half = full.join(left, "i").groupBy("p", "j").agg(F.sum(F.col("cov") * F.col("x")).alias("v"), F.max("n").alias("n"))
    forms = half.join(right, "j").filter("p <= q").groupBy("p", "q").agg(F.sum(F.col("v") * F.col("y")).alias("covariance"), F.max("n").alias("n"))
    own = forms.filter("p = q")
    pp, qq = own.select("p", F.col("covariance").alias("pp")), own.select("q", F.col("covariance").alias("qq"))
    z = NormalDist().inv_cdf((1 + level) / 2)
    out = forms.join(pp, "p").join(qq, "q").withColumn("se", F.sqrt(F.greatest((F.col("pp") * F.col("qq") + F.col("covariance") * F.col("covariance")) / F.col("n"), F.lit(0.0))))
    return out.select("p", "q", "covariance", "se", (F.col("covariance") - z * F.col("se")).alias("low"), (F.col("covariance") + z * F.col("se")).alias("high"), "n")


def qq_points(rows: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., rank, theoretical, empirical, fitted: each value against the normal quantile of (rank - 1/2) / n, and the
    straight line of least squares through these points. Nulls and non-numbers take no part."""
    held = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("empirical"))
    points = ranks.numbered(held, ["empirical"], by, total="n").withColumn("_p", (F.col("rank") - 0.5) / F.col("n"))
    points = points.withColumn("theoretical", F.expr(normal.ppf("_p"))).select(*by, "rank", "theoretical", "empirical")
    points = stored(points, "qq-points")
    line = points.groupBy(*by).agg(F.regr_slope("empirical", "theoretical").alias("_slope"), F.regr_intercept("empirical", "theoretical").alias("_level"))
    met = points.join(line, by) if by else points.crossJoin(F.broadcast(line))
    return met.select(*by, "rank", "theoretical", "empirical", (F.col("_level") + F.col("_slope") * F.col("theoretical")).alias("fitted"))


def mean_test(df: DataFrame, value: str, by: list[str], null: float = 0.0) -> DataFrame:
    """by..., mean, se, z, p: the two-sided test of the mean against `null`."""
    out = mean_error(df, value, by, null=null).select(*by, "mean", "se", "z")
    return out.withColumn("p", 2 * (1 - F.expr(normal.cdf("abs(z)"))))
