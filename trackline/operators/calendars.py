"""Trading calendars, rebalance schedules and as-of lookups.

A calendar is one narrow table of distinct dates, so its windows need no partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """date, idx from 0."""
    return panel.select("date").distinct().withColumn("idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def period_end(date: Column | str, freq: str) -> Column:
    """The label of a date's period: month or quarter end, or the week's Friday."""
    if freq == "M":
        return F.last_day(date)
    if freq == "Q":
        return F.last_day(F.add_months(F.date_trunc("quarter", F.col(date) if isinstance(date, str) else date), 2))
    if freq == "W":
        return F.next_day(F.date_sub(date, 1), "FR")
    raise ValueError(f"no such frequency: {freq}")


def schedule(cal: DataFrame, freq: str) -> DataFrame:
    """The last trading date of each period."""
    if freq == "D":
        return cal.select(F.col("date").alias("rebal_date"))
    return cal.groupBy(period_end("date", freq).alias("_p")).agg(F.max("date").alias("rebal_date")).select("rebal_date")


def snap(dates: DataFrame, cal: DataFrame, side: str = "left", fallback: bool = False) -> DataFrame:
    """date, snapped: the last trading date at or before (left), or the first at or after (right).

    With `fallback`, a date after the calendar's end snaps to its last date.
    """
    days = cal.select(F.col("date").alias("_d"))
    on = F.col("_d") <= F.col("date") if side == "left" else F.col("_d") >= F.col("date")
    pick = F.max("_d") if side == "left" else F.min("_d")
    out = dates.select("date").distinct().join(F.broadcast(days), on, "left").groupBy("date").agg(pick.alias("snapped"))
    if fallback:
        last = cal.agg(F.max("date").alias("_last"))
        out = out.crossJoin(F.broadcast(last)).select("date", F.coalesce("snapped", "_last").alias("snapped"))
    return out


def shift(dates: DataFrame, cal: DataFrame, days: int) -> DataFrame:
    """date, shifted by trading days; none beyond the calendar."""
    to = cal.select(F.col("date").alias("shifted"), (F.col("idx") - days).alias("idx"))
    return dates.join(cal, "date").join(to, "idx", "left").select("date", "shifted")


def anchored(cal: DataFrame, anchors: DataFrame, freq: str = "Q", k: int = 1) -> DataFrame:
    """rebal_date: in each interval between anchors the k-th trading date after its first one, and for `M`
    or `W` also the month starts or Mondays, snapped forward, up to the next anchor."""
    first = snap(anchors.select(F.col("date")), cal, "right").select(F.col("snapped").alias("anchor")).filter("anchor IS NOT NULL").distinct()
    first = first.withColumn("next", F.lead("anchor").over(Window.orderBy("anchor")))
    start = shift(first.select(F.col("anchor").alias("date")), cal, k).select(F.col("date").alias("anchor"), F.col("shifted").alias("rebal_date"))
    start = start.filter("rebal_date IS NOT NULL")
    if freq == "Q":
        return start.select("rebal_date").distinct()
    unit = {"M": "month", "W": "week"}[freq]
    last = cal.agg(F.max("date").alias("last"))
    spans = start.join(first, "anchor").crossJoin(F.broadcast(last)).select("rebal_date", F.coalesce("next", F.date_add("last", 1)).alias("end"))
    step = F.expr(f"interval 1 {unit}")
    inner = spans.select("rebal_date", "end", F.explode(F.sequence(F.to_date(F.date_trunc(unit, "rebal_date")), "end", step)).alias("date")).filter("date > rebal_date AND date < end")
    inner = inner.join(snap(inner, cal, "right"), "date").filter("snapped < end").select(F.col("snapped").alias("rebal_date"))
    return start.select("rebal_date").union(inner).distinct()


def valid_ranges(facts: DataFrame, keys: list[str], start: str, to: str = "until") -> DataFrame:
    """Add the first date from which a row no longer holds (null: still valid)."""
    return facts.withColumn(to, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def as_of(rows: DataFrame, facts: DataFrame, keys: list[str], start: str = "eff_date", date: str = "date") -> DataFrame:
    """Join to each row the facts that hold at its date: the version of the latest start not after it.

    All rows of a start form one version (a composition). Dates and starts, both without their rows, are put in one
    line, along which the latest start is carried; so rows and facts meet by equality only, and facts that are
    partitioned by their start are opened where a date needs them. Rows with a null key or before the first start go.
    """
    line = rows.select(*keys, F.col(date).alias("_at"), F.lit(None).cast(facts.schema[start].dataType).alias("_start"), F.lit(True).alias("_asked")).distinct()
    line = line.union(facts.select(*keys, F.col(start), F.col(start), F.lit(False)).distinct())
    so_far = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_at", "_asked")
    line = line.withColumn("_start", F.last("_start", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line = line.filter("_asked AND _start IS NOT NULL AND _at IS NOT NULL").select(*keys, F.col("_at").alias(date), "_start")
    held = facts.withColumnRenamed(start, "_start")
    return rows.join(line, [*keys, date]).join(held, [*keys, "_start"]).select(*rows.columns, F.col("_start").alias(start), *[c for c in held.columns if c not in {*keys, "_start"}])


def missing_as_of(rows: DataFrame, facts: DataFrame, start: str = "eff_date", date: str = "date") -> DataFrame:
    """Dates that have no version of exactly that start: what the exact mode refuses."""
    return rows.select(date).distinct().join(facts.select(F.col(start).alias(date)).distinct(), date, "left_anti")
