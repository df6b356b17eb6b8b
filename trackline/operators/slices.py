"""Slices of a panel: dates and assets with a check, years as partitions, complete rows, years rebased to one."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def take(panel: DataFrame, start: str | None = None, end: str | None = None, assets: list[str] | None = None) -> DataFrame:
    """The rows of a range of dates and of some assets. Both filters reach the scan; an asset that the panel does
    not hold at all is an error, told as the rows are read."""
    rows = panel
    if start is not None:
        rows = rows.filter(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.to_date(F.lit(end)))
    if assets is None:
        return rows
    asked = panel.sparkSession.createDataFrame([(a,) for a in assets], "asset string")
    # One row: the names asked for and not found.
    missing = asked.join(panel.select("asset").distinct(), "asset", "left_anti").agg(F.concat_ws(", ", F.sort_array(F.collect_list("asset"))).alias("_missing"))
    held = F.coalesce(F.when(F.col("_missing") != "", F.raise_error(F.concat(F.lit("no such assets: "), "_missing")).cast("boolean")), F.lit(True))
    return rows.filter(F.col("asset").isin(assets)).crossJoin(F.broadcast(missing)).filter(held).drop("_missing")


def needed_years(start: datetime.date | None, end: datetime.date | None, available: list[int]) -> list[int]:
    """The years of a range, or all available ones where a bound is missing; a reversed range or a year without data is
    an error."""
    first, last = (start.year if start else min(available)), (end.year if end else max(available))
    if first > last:
        raise ValueError("the range ends before it starts")
    missing = sorted(set(range(first, last + 1)) - set(available))
    if missing:
        raise ValueError(f"no prices for {missing}")
    return list(range(first, last + 1))


def write_years(panel: DataFrame, path: str) -> None:
    """A folder of year=YYYY partitions."""
    panel.withColumn("year", F.year("date")).repartition("year").write.partitionBy("year").parquet(path)


def list_years(spark: SparkSession, path: str) -> list[int]:
    """The years of such a folder, from the names of its partitions alone."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    return sorted(int(n[5:]) for n in names if n.startswith("year=") and n[5:].isdigit())


def read_years(spark: SparkSession, path: str, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
    """The panel of a range; other years are not opened."""
    years = needed_years(start, end, list_years(spark, path))
    return spark.read.parquet(path).filter(F.col("year").isin(years))


def complete_dates(panel: DataFrame, value: str = "ret") -> DataFrame:
    """The rows of the dates on which every asset has a finite value."""
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    n = panel.select("asset").distinct().agg(F.count("*").alias("_n"))
    dates = panel.filter(finite).groupBy("date").agg(F.count("*").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("date")
    return panel.join(dates, "date", "left_semi")


def rebased(series: DataFrame, value: str, by: list[str] = [], year: int | None = None) -> DataFrame:  # noqa: B006
    """by..., year, date, `value` over its first value of the year; one year only if asked."""
    rows = series.withColumn("year", F.year("date"))
    if year is not None:
        rows = rows.filter(F.col("year") == year)
    first = F.first(value).over(Window.partitionBy(*by, "year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(value, F.try_divide(F.col(value), first)).select(*by, "year", "date", value)


def price_column(columns: list[str]) -> str:
    """The column of a bar table that holds its prices: the adjusted close, else the close."""
    known = {c.lower().replace(" ", "_"): c for c in columns}
    for name in ("adj_close", "close", "price"):
        if name in known:
            return known[name]
    raise ValueError(f"no price among {columns}")


def returns_of(bars: DataFrame, method: str = "arithmetic", periods: int = 1, fill: bool = False) -> DataFrame:
    """date, asset, ret of a bar table by either method."""
    from trackline.operators import returns

    panel = bars.select("date", "asset", F.col(price_column(bars.columns)).alias("price"))
    if method == "arithmetic":
        return returns.arithmetic(panel, periods, fill)
    if method == "log":
        return returns.logarithmic(returns.forward_fill(panel) if fill else panel, periods)
    raise ValueError(f"no such return: {method}")


def rolling_volatility(returns: DataFrame, window: int, ann: int) -> DataFrame:
    """Annualised deviation of each asset's last `window` returns; null until there are so many."""
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-(window - 1), 0)
    vol: Column = F.when(F.count("ret").over(w) == window, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(float(ann))))
    return returns.select("date", "asset", vol.alias("vol"))
