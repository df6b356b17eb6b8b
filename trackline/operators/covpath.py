"""Covariance paths: one covariance for each of many dates, stored as Parquet by date and looked up as of a date.

A path is long: rebal_date, i, j (i <= j), cov. A stored path is partitioned by date, so a lookup opens the
partitions that it needs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.operators import calendars, covariance, matrix


def compute(returns: DataFrame, cal: DataFrame, length: int, method: str = "rolling", freq: str | None = None, lag: int = 0) -> DataFrame:
    """The path over a calendar's dates, or over the last dates of its weeks, months or quarters."""
    at = calendars.schedule(cal, freq) if freq else cal.select(F.col("date").alias("rebal_date"))
    window = covariance.windows(returns, cal, at, length, lag)
    plain = {"rolling": covariance.rolling, "lw": covariance.ledoit_wolf, "oas": covariance.oas}
    if method in plain:
        return plain[method](window, ["rebal_date"]).select("rebal_date", "i", "j", "cov")
    return matrix.covariances(window, [method]).drop("model")


def write(path: DataFrame, folder: str) -> None:
    path.repartition("rebal_date").write.partitionBy("rebal_date").parquet(folder)


def read(spark: SparkSession, folder: str, assets: list[str] | None = None) -> DataFrame:
    """A stored path, or the part of it between some assets."""
    path = spark.read.parquet(folder).select(F.col("rebal_date").cast("date").alias("rebal_date"), "i", "j", "cov")
    return path if assets is None else path.filter(F.col("i").isin(assets) & F.col("j").isin(assets))


def as_of(path: DataFrame, dates: DataFrame, strict: bool = False) -> DataFrame:
    """date, rebal_date, i, j, cov: the latest covariance not after each date. A date before the first covariance
    has none; with `strict` it is an error."""
    if not strict:
        return calendars.as_of(dates.select("date"), path, [], "rebal_date")
    first = path.agg(F.min("rebal_date").alias("_first"))
    good = F.coalesce(F.when(F.col("date") < F.col("_first"), F.raise_error(F.concat(F.lit("no covariance as of "), F.col("date").cast("string"))).cast("boolean")), F.lit(True))
    checked = dates.select("date").crossJoin(F.broadcast(first)).filter(good).select("date")
    return calendars.as_of(checked, path, [], "rebal_date")


def diagonal(path: DataFrame) -> DataFrame:
    """The variances of a path, with its other columns."""
    rest = [c for c in path.columns if c not in ("i", "j", "cov")]
    return path.filter("i = j").select(*rest, F.col("i").alias("asset"), F.col("cov").alias("variance"))


def purge(path: DataFrame, bench: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """rebal_date, asset, weight: the benchmark without assets of no variance, scaled to one again."""
    live = diagonal(path).filter(F.col("variance") > tolerance).select("rebal_date", "asset")
    kept = bench.join(live, ["rebal_date", "asset"], "left_semi")
    total = kept.groupBy("rebal_date").agg(F.sum("weight").alias("_t"))
    return kept.join(total, "rebal_date").select("rebal_date", "asset", F.try_divide("weight", "_t").alias("weight"))


def objective(path: DataFrame, with_bench: DataFrame, weights: DataFrame) -> DataFrame:
    """rebal_date, value: w' cov w - 2 w' cov_ib, what tracking a series of benchmark returns asks to be least.

    with_bench: rebal_date, asset, cov_ib; weights: rebal_date, asset, a.
    """
    own = covariance.quadratic(path, weights, ["rebal_date"])
    cross = with_bench.join(weights, ["rebal_date", "asset"]).groupBy("rebal_date").agg(F.sum(F.col("a") * F.col("cov_ib")).alias("_c"))
    return own.join(cross, "rebal_date").select("rebal_date", (F.col("variance") - 2 * F.col("_c")).alias("value"))
