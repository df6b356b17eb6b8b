"""Decay tuning against a plain walk over all dates."""

import datetime

import numpy as np
import pandas as pd
import pytest

from trackline.operators import decay


def plain(frame, window, decays, ridge, least, diagonal):
    x, out = frame.to_numpy(float), []
    for d in decays:
        s = frame.iloc[:window].cov(ddof=1).fillna(0.0).to_numpy()
        s, found = np.diag(np.diag(s)) if diagonal else s, []
        for t in range(window + 1, len(x)):
            s = d * s + (1 - d) * frame.iloc[t - window : t].cov(ddof=1).fillna(0.0).to_numpy()
            seen = np.isfinite(x[t])
            if seen.sum() < least:
                continue
            m = s[np.ix_(seen, seen)] + ridge * np.eye(seen.sum())
            sign, logdet = np.linalg.slogdet(m)
            if np.linalg.eigvalsh(m)[0] > 0:
                found.append(-0.5 * (logdet + x[t][seen] @ np.linalg.solve(m, x[t][seen])))
        out.append((d, np.mean(found) if found else None, len(found)))
    return out


@pytest.mark.parametrize(("block", "diagonal", "gaps"), [(5, False, True), (7, True, False), (None, False, True), (1000, False, False)])
def test_blocks_score_as_one_walk(spark, block, diagonal, gaps):
    rng = np.random.default_rng(3)
    dates = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(60)]
    frame = pd.DataFrame(rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)), index=dates, columns=list("dacb"))
    if gaps:
        frame = frame.mask(rng.random(frame.shape) < 0.1)
        frame.iloc[30, :] = np.nan
    long = [(d, a, None if pd.isna(v) else float(v)) for d, row in frame.iterrows() for a, v in row.items()]
    returns = spark.createDataFrame(long, "date date, asset string, ret double")
    cal = spark.createDataFrame([(d, k) for k, d in enumerate(dates)], "date date, idx long")
    grid = (0.7, 0.8, 0.85, 0.9, 0.94, 0.96, 0.97, 0.98, 0.985, 0.995, 1.0)
    got = {r.decay: (r.score, r.n) for r in decay.scores(returns, cal, 12, grid, least=3, diagonal=diagonal, block=block).collect()}
    want = plain(frame[sorted(frame)], 12, grid[1:-1], 1e-8, 3, diagonal)
    assert set(got) == set(grid[1:-1])
    for d, score, n in want:
        assert got[d][1] == n and got[d][0] == pytest.approx(score, rel=1e-9)


def test_nothing_to_score(spark):
    returns = spark.createDataFrame([], "date date, asset string, ret double")
    cal = spark.createDataFrame([], "date date, idx long")
    assert [tuple(r) for r in decay.scores(returns, cal, 5, (0.9,)).collect()] == [(0.9, None, 0)]
    scored = spark.createDataFrame([(0.9, -1.0, 3), (0.95, -1.0, 3), (0.99, None, 0)], "decay double, score double, n long")
    assert decay.tune(scored, 0.94, 100, 20) == 0.9 and decay.tune(scored, 0.94, 25, 20) == 0.94
    assert len(decay.GRID) == 40 and decay.GRID[0] == 0.8 and decay.GRID[-1] == 0.995


def test_covariance_of_gaps_equals_pandas():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 5))
    x[rng.random(x.shape) < 0.4] = np.nan
    x[:, 4] = np.nan
    assert np.allclose(decay.paired_covariance(x), pd.DataFrame(x).cov().fillna(0).to_numpy(), atol=1e-13)
