"""Scenario grids and draws of exclusions.

A grid is a DataFrame; what is done is taken off by an anti join, and new results are appended, so a run
that stops goes on where it was. A scenario draws from numpy's generator with its own seed, so a result does
not depend on where or when it is computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """The product of the axes: one row a scenario."""
    names = list(axes)
    out = spark.range(1).select(*[F.explode(F.array(*[F.lit(v) for v in axes[n]])).alias(n) if k == 0 else F.lit(None).alias(n) for k, n in enumerate(names)])
    out = out.select(names[0])
    for n in names[1:]:
        out = out.withColumn(n, F.explode(F.array(*[F.lit(v) for v in axes[n]])))
    return out


def to_do(scenarios: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Scenarios without a successful run."""
    if done is None:
        return scenarios
    return scenarios.join(done.filter("status = 'success'").select(*keys).distinct(), keys, "left_anti")


def exclusion_draws(assets: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario, asset: what each scenario (scenario, share, seed) leaves out: floor(share n) assets, drawn by
    the scenario's own generator from the sorted names."""
    names = assets.select("asset").distinct().agg(F.sort_array(F.collect_set("asset")).alias("names"))

    def draw(batches):
        for batch in batches:
            rows = []
            for s in batch.itertuples(index=False):
                chosen = np.random.default_rng(int(s.seed)).choice(len(s.names), size=int(len(s.names) * s.share), replace=False)
                rows += [(s.scenario, s.names[k]) for k in chosen]
            yield pd.DataFrame(rows, columns=["scenario", "asset"])

    # The universe is one row: hundreds of names.
    return scenarios.select("scenario", "share", "seed").crossJoin(F.broadcast(names)).mapInPandas(draw, f"scenario {scenarios.schema['scenario'].dataType.simpleString()}, asset string")
