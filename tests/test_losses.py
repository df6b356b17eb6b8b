"""Losses with parts of a universe left out, and their moments over seeds."""

import math

import numpy as np
import pytest

from trackline.operators import covariance

COV = "d string, i string, j string, cov double"


def table(spark, d, names, s):
    return spark.createDataFrame([(d, a, b, float(s[x, y])) for x, a in enumerate(names) for y, b in enumerate(names) if x <= y], COV)


def test_held_out_losses_are_those_of_the_rest(spark):
    rng = np.random.default_rng(3)
    names = [f"a{k}" for k in range(7)]
    one, other = (np.cov(rng.normal(size=(7, 30))) for _ in range(2))
    parts = {"a0": 0, "a1": 1, "a2": 2, "a3": 0, "a4": 1, "a5": 2}
    rows = spark.createDataFrame(list(parts.items()), "asset string, part int")
    got = covariance.held_out_losses(table(spark, "x", names, one), table(spark, "x", names, other), rows, ["d"]).collect()
    assert {r.seed for r in got} == {0, 1, 2} and len(got) == 3
    for r in got:
        # a6 is of no part and stays.
        at = [k for k, a in enumerate(names) if parts.get(a) != r.seed]
        gap = (one - other)[np.ix_(at, at)]
        assert r.frobenius == pytest.approx(np.linalg.norm(gap)) and r.largest == pytest.approx(np.abs(gap).max())


def test_absent_pairs_count_as_zero_and_empty_tables_give_none(spark):
    one = spark.createDataFrame([("x", "a", "a", 3.0)], COV)
    parts = spark.createDataFrame([("a", 0), ("b", 1)], "asset string, part int")
    other = spark.createDataFrame([("x", "a", "b", 2.0), ("x", "b", "b", 1.0)], COV)
    got = {r.seed: (r.frobenius, r.largest) for r in covariance.held_out_losses(one, other, parts, ["d"]).collect()}
    assert got == {0: (1.0, 1.0), 1: (3.0, 3.0)}
    assert covariance.held_out_losses(one.limit(0), other.limit(0), parts, ["d"]).count() == 0


def test_moments_over_seeds(spark):
    rows = [("m", 0, 1.0, 5.0), ("m", 1, 3.0, None), ("m", 2, math.nan, math.nan), ("n", 0, None, 2.0)]
    df = spark.createDataFrame(rows, "model string, seed int, f double, g double")
    got = {(r.model, r.metric): (r.n, r["mean"], r.std) for r in covariance.over_seeds(df, ["f", "g"], ["model"]).collect()}
    assert got == {("m", "f"): (2, 2.0, pytest.approx(math.sqrt(2))), ("m", "g"): (1, 5.0, 0.0), ("n", "f"): (0, None, None), ("n", "g"): (1, 2.0, 0.0)}
