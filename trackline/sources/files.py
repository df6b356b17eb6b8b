"""Readers of index folders: yearly price files, composition blocks, mappings, sectors and exclusions, as CSV.

An index folder holds YYYY.csv files and the others; Spark reads them in parallel, in long form.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.operators import universe

# What counts as true in a file of exclusions.
TRUE_WORDS = ("1", "true", "yes", "y", "oui")


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    """The first columns under new names, trimmed."""
    return df.select(*[F.trim(F.col(f"`{old}`")).alias(new) for old, new in zip(df.columns, names, strict=False)])


def read_prices(spark: SparkSession, paths: dict[int, str], mapping: DataFrame | None = None) -> DataFrame:
    """date, asset, price, year of the files of some years. The first column is the date, all others are assets;
    unreadable dates and prices go, and of a repeated date the last price stays, that of the last file, line and column.

    mapping: date, ticker, id_global; a column named by an id is its latest ticker up to the end of the file's year."""
    parts = []
    for y, path in sorted(paths.items()):
        df = _text(spark, path)
        first, rest = df.columns[0], df.columns[1:]
        row = F.monotonically_increasing_id().alias("_row")
        cells = F.array(*[F.struct(F.lit(c.strip()).alias("asset"), F.expr(f"try_cast(`{c}` AS DOUBLE)").alias("price")) for c in rest])
        long = df.select(F.to_date(F.try_to_timestamp(F.col(f"`{first}`"))).alias("date"), row, F.posexplode(cells).alias("_at", "p"))
        long = long.select("date", "p.asset", "p.price", F.struct(F.lit(y), "_row", "_at").alias("_row"), F.lit(y).alias("year"))
        if mapping is not None:
            long = universe.remap(long.withColumnRenamed("asset", "id_global"), mapping, datetime.date(y, 12, 31))
        parts.append(long.select("date", "asset", "price", "_row", "year"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.filter("date IS NOT NULL AND price IS NOT NULL").groupBy("date", "asset").agg(F.max_by("price", "_row").alias("price"), F.max("year").alias("year"))
    some = F.max(F.abs("price"))
    out = out.join(out.groupBy("date").agg(some.alias("m")).filter("m > 0").select("date"), "date", "left_semi")
    return out.join(out.groupBy("asset").agg(some.alias("m")).filter("m > 0").select("asset"), "asset", "left_semi")


def read_blocks(spark: SparkSession, path: str, mapping: DataFrame | None = None) -> DataFrame:
    """eff_date, ticker, id_global, weight from a sheet of three-column blocks side by side.

    A block begins in a column whose first row is a date; below stand ticker, id and weight. Blank tickers and
    unreadable weights go; repeated tickers of a date are summed. With a mapping (date, ticker, id_global), an id counts as
    its latest ticker up to the block's date, if it has one.
    """
    df = spark.read.option("header", False).option("inferSchema", False).csv(path)
    head = df.limit(1).collect()
    if not head:
        return spark.createDataFrame([], "eff_date date, ticker string, id_global string, weight double")
    dated = df.limit(1).select(*[F.to_date(F.try_to_timestamp(F.col(c))).alias(c) for c in df.columns]).first()
    starts, k = [], 0
    while k < len(df.columns):
        if dated[k] is not None and k + 2 < len(df.columns):
            starts.append(k)
            k += 3
        else:
            k += 1
    c = df.columns
    blocks = F.array(*[F.struct(F.lit(dated[k]).alias("eff_date"), F.trim(F.col(c[k])).alias("ticker"), F.trim(F.col(c[k + 1])).alias("id_global"), F.expr(f"try_cast(trim(`{c[k + 2]}`) AS DOUBLE)").alias("weight")) for k in starts])
    rows = df.select(F.explode(blocks).alias("b")).select("b.*").filter("ticker <> '' AND weight IS NOT NULL AND try_to_timestamp(ticker) IS NULL")
    if mapping is not None:
        known = rows.select("eff_date", "id_global").distinct().join(mapping.select("id_global", F.col("ticker").alias("_ticker"), "date"), "id_global").filter("date <= eff_date")
        known = known.groupBy("eff_date", "id_global").agg(F.max_by("_ticker", F.struct("date", "_ticker")).alias("_ticker"))
        rows = rows.join(known, ["eff_date", "id_global"], "left").withColumn("ticker", F.coalesce("_ticker", "ticker"))
    return rows.groupBy("eff_date", "ticker", "id_global").agg(F.sum("weight").alias("weight"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """date, ticker, id_global, id_company by position."""
    df = _named(_text(spark, path), ["date", "ticker", "id_global", "id_company"])
    return df.withColumn("date", F.to_date(F.try_to_timestamp("date"))).filter("date IS NOT NULL")


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    """asset, sector by position; of repeated assets the last line counts."""
    df = _named(_text(spark, path), ["asset", "sector"]).withColumn("_row", F.monotonically_increasing_id()).filter("asset <> '' AND sector <> ''")
    return df.groupBy("asset").agg(F.max_by("sector", "_row").alias("sector"))


def read_exclusions(spark: SparkSession, path: str, mapping: DataFrame) -> DataFrame:
    """asset: the excluded tickers. A company id means its latest ticker; else the file's own ticker counts."""
    df = _text(spark, path)
    df = df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().upper().replace(" ", "_")) for c in df.columns])
    if "EST_EXCLUS" not in df.columns:
        raise ValueError("the exclusions have no column EST EXCLUS")
    for c in ("ID_BB_COMPANY", "TICKER"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    latest = mapping.groupBy("id_company").agg(F.max_by("ticker", F.struct("date", "ticker")).alias("latest"))
    rows = df.filter(F.lower("EST_EXCLUS").isin(*TRUE_WORDS)).join(latest, F.col("ID_BB_COMPANY") == F.col("id_company"), "left")
    return rows.select(F.coalesce("latest", "TICKER").alias("asset")).filter("asset <> ''").distinct()


def load_index(spark: SparkSession, root: str, index: str, years: list[int]) -> dict[str, DataFrame]:
    """All tables of one index folder."""
    folder = f"{root}/{index}"
    mapping = read_mapping(spark, f"{folder}/Mapping.csv")
    return {"prices": read_prices(spark, {y: f"{folder}/{y}.csv" for y in years}), "compositions": read_blocks(spark, f"{folder}/Compo.csv"), "mapping": mapping, "sectors": read_sectors(spark, f"{folder}/sector_mapping.csv"), "exclusions": read_exclusions(spark, f"{folder}/Exclusions.csv", mapping)}
