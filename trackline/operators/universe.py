"""Universe filters: exclusions, sectors, identifiers and weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise_weights(weights: DataFrame, key: str = "eff_date") -> DataFrame:
    """Sum repeated assets, refuse negative weights and empty sums, scale each date to one."""
    w = weights.groupBy(key, "asset").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(key))
    bad = F.when(F.col("weight") < -1e-12, F.raise_error(F.lit("a weight is negative"))).when(total <= 0, F.raise_error(F.lit("weights sum to zero")))
    return w.select(key, "asset", F.coalesce(bad.cast("double"), F.col("weight") / total).alias("weight"))


def exclusions(universe: DataFrame, caps: DataFrame | None = None, share: float = 0.0, explicit: DataFrame | None = None) -> DataFrame:
    """Assets of the universe to leave out: the named ones, and the smallest ceil(share * n) by cap."""
    parts = []
    if caps is not None and share > 0:
        n = F.count("*").over(Window.partitionBy())
        rank = F.row_number().over(Window.orderBy("cap", "asset"))
        parts.append(caps.withColumns({"_n": n, "_r": rank}).filter(F.col("_r") <= F.ceil(F.col("_n") * share)).select("asset"))
    if explicit is not None:
        parts.append(explicit.select("asset"))
    out = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return out.distinct().join(universe, "asset", "left_semi")


def keep_only(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    return rows.join(excluded, "asset", "left_anti")


def random_exclusion(assets: list[str], share: float, seed: int, forced: tuple[str, ...] = ()) -> list[str]:
    """The names that a seed excludes after the forced ones: floor(share * n), without replacement."""
    left = [a for a in assets if a not in set(forced)]
    drawn = np.random.default_rng(seed).choice(left, size=int(len(left) * share), replace=False) if left else []
    return sorted({*forced, *map(str, drawn)})


def normalise_ticker(ticker: str):
    """Trimmed, without the suffix ` Equity`, upper case."""
    return F.upper(F.regexp_replace(F.trim(ticker), r"(?i) Equity$", ""))


def with_sector(rows: DataFrame, sectors: DataFrame, unknown: str = "UNKNOWN") -> DataFrame:
    return rows.join(sectors, "asset", "left").withColumn("sector", F.coalesce("sector", F.lit(unknown)))


def remap(rows: DataFrame, mapping: DataFrame, as_of) -> DataFrame:
    """Replace ids by tickers: the latest up to a date, else any, else the id itself.

    mapping: date, ticker, id_global; rows: id_global and more.
    """
    latest = mapping.filter(F.col("date") <= F.lit(as_of)).groupBy("id_global").agg(F.max_by("ticker", F.struct("date", "ticker")).alias("_latest"))
    any_ = mapping.groupBy("id_global").agg(F.max_by("ticker", F.struct("date", "ticker")).alias("_any"))
    return rows.join(latest, "id_global", "left").join(any_, "id_global", "left").withColumn("asset", F.coalesce("_latest", "_any", "id_global")).drop("_latest", "_any")


def small_caps_as_of(caps: DataFrame, at: DataFrame, share: float) -> DataFrame:
    """rebal_date, asset: the smallest ceil(share * n) by the last snapshot of caps (date, asset, cap) not after the date
    of each row of `at` (rebal_date, date)."""
    from trackline.operators import calendars

    held = calendars.as_of(at.select("rebal_date", "date"), caps.withColumnRenamed("date", "eff_date"), [])
    day = Window.partitionBy("rebal_date")
    rows = held.withColumns({"_n": F.count("*").over(day), "_r": F.row_number().over(day.orderBy("cap", "asset"))})
    return rows.filter(F.col("_r") <= F.ceil(F.col("_n") * share)).select("rebal_date", "asset")


def without_tickers(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows whose asset a file does not name; both are compared in their normal form."""
    keys = named.select(normalise_ticker("asset").alias("_ticker")).distinct()
    return rows.join(keys, normalise_ticker("asset") == F.col("_ticker"), "left_anti")
