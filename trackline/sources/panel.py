"""The price panel on the star schema: an asset is a customer nation, a sector its region, a bar a month or week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.sources.tables import table

#: Bars in a year.
BARS = {"month": 12, "week": 52}


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, sector."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("asset"), F.col("r_name").alias("sector"))


def bars(spark: SparkSession, sf_dir: str, freq: str = "month") -> DataFrame:
    """date, asset, price (revenue over quantity), revenue.

    Lines are summed by order and bar before they meet the orders, so the large join moves sums.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date(F.date_trunc(freq, "l_shipdate")).alias("date"), "l_quantity", "l_extendedprice")
    lines = lines.groupBy("l_orderkey", "date").agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("asset"))
    # A table of nations has a few hundred rows at any scale.
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("date", "asset").agg((F.sum("v") / F.sum("q")).alias("price"), F.sum("v").alias("revenue"))


def compositions(panel: DataFrame) -> DataFrame:
    """eff_date (a quarter's first day), asset, weight: the previous quarter's share of revenue."""
    quarter = panel.groupBy(F.to_date(F.date_trunc("quarter", "date")).alias("q"), "asset").agg(F.sum("revenue").alias("v"))
    total = quarter.groupBy("q").agg(F.sum("v").alias("t"))
    return quarter.join(total, "q").select(F.add_months("q", 3).alias("eff_date"), "asset", (F.col("v") / F.col("t")).alias("weight"))
