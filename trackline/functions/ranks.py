"""Numbers along a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.sources.shared import stored


def numbered(rows: DataFrame, order: list[str], by: list[str] = [], to: str = "rank", total: str | None = None) -> DataFrame:  # noqa: B006
    """rows with `to` from 1 in the order of `order` within `by`, and the number of rows of its group as `total`.

    Rows are sorted in ranges and written; the rows of a range start after those of the ranges before it, of
    which only the counts are needed. Equal rows are told apart by where they stand, so one value that most
    rows share is no hot key. Nulls come first.
    """
    keys = [*by, *order, "_place"]
    ranged = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranks").withColumn("_part", F.shiftright("_place", 33))
    parts = ranged.groupBy(*by, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_held"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_held").over(before), F.lit(0)), "_all": F.sum("_held").over(whole)}).drop("_held")
    on = F.col("r._part") == F.col("p._part")
    for b in by:
        on = on & F.col(f"r.{b}").eqNullSafe(F.col(f"p.{b}"))
    out = ranged.alias("r").join(parts.alias("p"), on)
    number = (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(to)
    return out.select(*[f"r.{c}" for c in rows.columns], number, *([F.col("_all").alias(total)] if total else []))
