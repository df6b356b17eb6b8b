"""Result tables of long runs: resumable, idempotent, and with columns that may grow.

A store is a folder with one Parquet table per kind of result and a log of commits. Work comes in batches; a batch
writes its rows of every table into partitions of its own, over whatever an earlier attempt left there, and then one
row of the log. Readers see the batches that the log has, so an interrupted batch is invisible, a repeated one
replaces itself, and nothing is written twice. A batch's scenarios follow from the grid and the batch size alone, so
each run cuts the same batches.

Each table keeps its columns in a small file. A commit may bring new columns, which older rows then have as nulls,
or lack some; a column of another type is refused, but for numbers that fit into a wider type.

One run writes to a store at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, MapType, StringType, StructField, StructType

from trackline.functions.ranks import numbered

LOG = StructType().add("batch", "long").add("rows", MapType(StringType(), LongType()))
#: Numbers that a wider type holds without loss.
WIDER = {("tinyint", "smallint"), ("tinyint", "int"), ("smallint", "int"), ("tinyint", "bigint"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("int", "double"), ("smallint", "double"), ("tinyint", "double")}


def merged_schema(old: StructType, new: StructType, where: str = "table") -> StructType:
    """The columns of both, old ones first; a column of another type is an error unless one type holds the other."""
    fields = {f.name: f.dataType for f in old}
    for f in new:
        kind = fields.setdefault(f.name, f.dataType)
        names = kind.simpleString(), f.dataType.simpleString()
        if names[0] != names[1] and (names[1], names[0]) not in WIDER:
            raise TypeError(f"column {f.name} of {where} is {names[0]}, not {names[1]}")
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def _as(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly these columns; what it lacks is null."""
    has = set(df.columns)
    null: Callable[[DataType], object] = lambda t: F.lit(None).cast(t)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in has else null(f.dataType)).alias(f.name) for f in schema])


class ResultStore:
    """The tables of one folder on storage that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, StructType]):
        """Create what is missing of the tables; those that are there gain the columns that they lack."""
        self.spark, self.folder = spark, folder.rstrip("/")
        for name, schema in tables.items():
            self.evolve(name, schema)

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def schema(self, table: str) -> StructType | None:
        """The columns of a table, or None where there is no such table."""
        place, files = self._place(f"_schemas/{table}.json")
        if not files.exists(place):
            return None
        told = self.spark.read.text(f"{self.folder}/_schemas/{table}.json", wholetext=True).first()[0]
        return StructType.fromJson(json.loads(told))

    def evolve(self, table: str, schema: StructType) -> StructType:
        """Add columns to a table, or create it."""
        old = self.schema(table)
        new = schema if old is None else merged_schema(old, schema, table)
        if new != old:
            # Written aside and moved, so that no reader meets half a file.
            aside, files = self._place(f"_schemas/{table}.json.new")
            out = files.create(aside, True)
            out.write(bytearray(new.json().encode()))
            out.close()
            place, _ = self._place(f"_schemas/{table}.json")
            files.delete(place, False)
            files.rename(aside, place)
        return new

    def commits(self) -> DataFrame:
        """batch, rows: the batches that are complete, and how many rows each table got."""
        place, files = self._place("_commits")
        if not files.exists(place):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/_commits")

    def tables(self) -> list[str]:
        """The names of all tables."""
        place, files = self._place("_schemas")
        return sorted(f.getPath().getName()[:-5] for f in files.listStatus(place) if f.getPath().getName().endswith(".json")) if files.exists(place) else []

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Write a batch's rows of each table, over those of an earlier attempt, then enter it in the log.

        Tables that are not named get no rows of this batch."""
        place, files = self._place(f"_commits/batch={batch}")
        files.delete(place, True)
        for name in set(self.tables()) - set(tables):
            files.delete(self._place(f"{name}/batch={batch}")[0], True)
        counts = {}
        for name, df in tables.items():
            schema = self.evolve(name, df.schema)
            target = f"{self.folder}/{name}/batch={batch}"
            _as(df, schema).write.mode("overwrite").parquet(target)
            counts[name] = self.spark.read.schema(schema).parquet(target).count()
        row = self.spark.createDataFrame([(counts,)], StructType([LOG["rows"]]))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/_commits/batch={batch}")

    def read(self, table: str) -> DataFrame:
        """All committed rows of a table, with their batch."""
        schema = self.schema(table)
        if schema is None:
            raise ValueError(f"no table {table} in {self.folder}")
        place, files = self._place(table)
        whole = StructType([*schema.fields, StructField("batch", LOG["batch"].dataType)])
        if not files.exists(place):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.folder}/{table}").join(self.commits().select("batch"), "batch", "left_semi").select(*whole.names)


def batched(scenarios: DataFrame, keys: list[str], size: int) -> DataFrame:
    """scenarios with the number of their batch: `size` scenarios in the order of their keys each, from 0."""
    return numbered(scenarios.dropDuplicates(keys), keys, to="_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


class ResumableRun:
    """Works through a grid of scenarios in batches and keeps the results in a store.

    work(scenarios) returns the tables of some scenarios, by name. Each batch also writes the table `run_log`: the keys
    and status of each scenario, `success`, or `error` with the first 250 characters of what was raised; work may
    return a `run_log` of its own. Scenarios without success are tried again by the next run.
    """

    def __init__(self, store: ResultStore, scenarios: DataFrame, keys: list[str], size: int = 100):
        self.store, self.keys = store, keys
        self.grid = batched(scenarios, keys, size)
        fields = [scenarios.schema[k] for k in keys]
        store.evolve("run_log", StructType(fields).add("status", "string").add("error", "string"))

    def done(self) -> DataFrame:
        """The keys that have succeeded."""
        return self.store.read("run_log").filter("status = 'success'").select(*self.keys).distinct()

    def pending(self) -> DataFrame:
        """The scenarios that have not, with their batch."""
        on = [F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}")) for k in self.keys]
        return self.grid.alias("g").join(self.done().alias("d"), on, "left_anti")

    def run_batch(self, batch: int, work: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
        own = self.grid.filter(F.col("batch") == batch).drop("batch")
        log = own.select(*self.keys, F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))
        try:
            self.store.commit(batch, {"run_log": log} | work(own))
        except Exception as e:  # noqa: BLE001
            # One batch that fails must not end the run; what it has written goes with it.
            self.store.commit(batch, {"run_log": log.withColumns({"status": F.lit("error"), "error": F.lit(str(e)[:250])})})

    def run(self, work: Callable[[DataFrame], dict[str, DataFrame]], most: int | None = None) -> list[int]:
        """Run the batches that hold pending scenarios, at most `most` of them; the numbers of those that were run.

        A batch is run whole, so that it replaces what an earlier attempt left of it.
        """
        numbers = [r["batch"] for r in self.pending().select("batch").distinct().orderBy("batch").collect()][:most]
        for batch in numbers:
            self.run_batch(batch, work)
        return numbers
