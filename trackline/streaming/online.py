"""Online updates with Structured Streaming: bars from events, and a covariance that each bar moves on."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackline.functions import kernels


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*events*").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total: tumbling windows, closed by the watermark."""
    e = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return e.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def ewma_updates(vectors: DataFrame, size: int, decay: float = 0.94) -> DataFrame:
    """model, seq, trace, frobenius after each vector (model, seq, r) that arrives, in the order of seq.

    The state is the covariance matrix; it starts at zero. A model's vectors must arrive in order over
    batches; within a batch they are sorted.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = np.array(json.loads(state.get[0])) if state.exists else np.zeros((size, size))
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            s = kernels.ewma_step(s, np.asarray(r.r, float), decay)
            out.append((key[0], r.seq, float(np.trace(s)), float(np.linalg.norm(s))))
        state.update((json.dumps(s.tolist()),))
        yield pd.DataFrame(out, columns=["model", "seq", "trace", "frobenius"])

    return vectors.groupBy("model").applyInPandasWithState(step, "model string, seq long, trace double, frobenius double", "s string", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def durable_state(spark: SparkSession) -> Iterator[None]:
    """Within, streams keep their state in RocksDB, which states with first values and large matrices need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is now into Parquet files and read them; folder is a shared one."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
