"""The normal distribution, ranks over ranges, joint moments and projections against plain Python."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackline.functions import moments, normal, ranks


def test_normal_expressions_reach_double_precision(spark):
    ps = [1e-300, 1e-20, 1e-5, 0.01, 0.07, 0.075, 0.08, 0.3, 0.5, 0.61, 0.925, 0.93, 0.99, 1 - 1e-10]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(normal.ppf("p")).alias("z")).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-14, abs=1e-15)
    outside = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(F.expr(normal.ppf("p")).alias("z")).collect()
    assert [r.z for r in outside] == [None] * 4
    xs = [float(x) for x in np.linspace(-12, 12, 49)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", F.expr(normal.cdf("x")).alias("c")).collect():
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-12)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbers_follow_the_order_whatever_the_ranges(spark, by):
    """Most rows share one value; groups are null, rare and common."""
    rng = np.random.default_rng(2)
    rows = [(None if k % 50 == 0 else ("a" if k % 3 else "b"), 7.0 if k % 4 else float(rng.normal()), k) for k in range(2000)] + [("c", None, -1)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(7)
    got = ranks.numbered(df, ["v", "id"], by, total="n").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[0] if by else 0, []).append(r)
    want = {r[2]: (k + 1, len(own)) for own in groups.values() for k, r in enumerate(sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2])))}
    assert {r.id: (r["rank"], r.n) for r in got} == want
    assert ranks.numbered(df.limit(0), ["v"], by).collect() == []


def test_joint_likelihood_and_projections_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 3))
    long = [(str(1000 + t), "abc"[k], None if (t, k) == (4, 2) else float(x[t, k])) for t in range(40) for k in range(3)]
    cov = moments.joint_mle(spark.createDataFrame(long, "date string, asset string, ret double"))
    got = {(r.i, r.j): r for r in cov.collect()}
    frame = pd.DataFrame(x.copy())
    frame.iloc[4, 2] = np.nan
    mean = frame.mean()
    sigma = (frame - mean).to_numpy().T @ (frame - mean).to_numpy() / 40
    for (i, j), r in got.items():
        a, b = "abc".index(i), "abc".index(j)
        assert (r.mean_i, r.mean_j, r.n) == (pytest.approx(mean[a]), pytest.approx(mean[b]), 40)
        assert (r.cov is None) if np.isnan(sigma[a, b]) else r.cov == pytest.approx(sigma[a, b])
    s = np.cov(x.T, ddof=0)
    full = spark.createDataFrame([("abc"[i], "abc"[j], float(s[i, j])) for i in range(3) for j in range(i, 3)], "i string, j string, cov double")
    held = {"one": [1.0, 0, 0], "mix": [0.2, -0.5, 1.3]}
    ports = spark.createDataFrame([(p, "abc"[k], float(w)) for p, ws in held.items() for k, w in enumerate(ws)], "portfolio string, asset string, a double")
    for r in moments.projected_covariances(full, ports, F.lit(40)).collect():
        v, w = np.array(held[r.p]), np.array(held[r.q])
        assert r.covariance == pytest.approx(v @ s @ w)
        assert r.se == pytest.approx(np.sqrt((v @ s @ v * (w @ s @ w) + (v @ s @ w) ** 2) / 40))
        assert (r.low, r.high) == (pytest.approx(r.covariance - 1.959963984540054 * r.se), pytest.approx(r.covariance + 1.959963984540054 * r.se))


def test_quantile_points_skip_what_is_no_number(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, None, 1.0, float("nan"), 2.0, 2.0]], "v double")
    got = sorted((r["rank"], r.theoretical, r.empirical, r.fitted) for r in moments.qq_points(df, "v").collect())
    z = [NormalDist().inv_cdf((k + 0.5) / 4) for k in range(4)]
    slope, level = np.polyfit(z, [1, 2, 2, 3], 1)
    assert [g[:3] for g in got] == [(k + 1, pytest.approx(z[k]), v) for k, v in enumerate([1.0, 2.0, 2.0, 3.0])]
    assert [g[3] for g in got] == pytest.approx([level + slope * q for q in z])
