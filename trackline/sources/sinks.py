"""Result tables of scenario runs: Parquet folders by model, appended to, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append(df: DataFrame, path: str, partition: str | None = "model") -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one where nothing has been written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def log_rows(keys: DataFrame, status: str, error: str | None = None, seconds: float | None = None) -> DataFrame:
    """Rows of the run log; errors are cut to 250 characters."""
    return keys.withColumns({"status": F.lit(status), "duration_s": F.lit(seconds).cast("double"), "error": F.substring(F.lit(error).cast("string"), 1, 250)})
