"""Folders for what a query must write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where that is unset and Spark is local."""
    top = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read again: what starts from it does not compute it anew."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
