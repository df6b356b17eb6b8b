"""The decay of an EWMA covariance, chosen by quasi-likelihood with a scan over blocks of dates.

At each date t after the first w + 1 the state moves to decay S + (1 - decay) C(t), C(t) being the sample
covariance of the w returns before t, and S scores the returns of t. A state needs all earlier dates, but
it is linear in them: a block of dates turns its state before into decay^length times that, plus a matrix of its
own. So three steps run in parallel: every block finds its own matrix; these are scanned along the blocks,
row by row of the matrix; every block scores its dates from the state it starts with. A task holds one block
with the w dates before it and a few decays, never the whole panel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.sources.shared import stored

#: From 0.80 on in steps of 0.005, below 1.
GRID = tuple(round(0.8 + 0.005 * k, 3) for k in range(40))
#: Decays that one task carries along its block.
TOGETHER = 8


def paired_covariance(x: np.ndarray) -> np.ndarray:
    """Sample covariances of the dates that both columns have; zero where these are fewer than two."""
    seen = np.isfinite(x)
    if seen.all():
        d = x - x.mean(axis=0)
        return d.T @ d / (len(x) - 1) if len(x) > 1 else np.zeros((x.shape[1],) * 2)
    m = seen.astype(float)
    held = np.maximum(m.sum(axis=0), 1)
    # Centred by each column's own mean first, so that little cancels.
    d = np.where(seen, x - np.where(seen, x, 0).sum(axis=0) / held, 0)
    n, s = m.T @ m, d.T @ m
    return np.where(n > 1, (d.T @ d - s * s.T / np.maximum(n, 1)) / np.maximum(n - 1, 1), 0.0)


def likelihood(states: np.ndarray, r: np.ndarray, ridge: float, least: int) -> np.ndarray:
    """-1/2 (log det + quadratic form) of a date's finite returns under each state; not a number where there is none."""
    seen = np.flatnonzero(np.isfinite(r))
    out = np.full(len(states), np.nan)
    if len(seen) < max(least, 1):
        return out
    own = states[:, seen[:, None], seen] + ridge * np.eye(len(seen))
    for k, s in enumerate(own):
        try:
            root = np.linalg.cholesky(s)
        except np.linalg.LinAlgError:
            continue
        y = np.linalg.solve(root, r[seen])
        out[k] = -0.5 * (2 * np.log(np.diag(root)).sum() + y @ y)
    return out


def _panel(rows: pd.DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The first index, and returns by date and asset without gaps."""
    first = int(rows["idx"].min())
    x = np.full((int(rows["idx"].max()) - first + 1, size), np.nan)
    x[rows["idx"].to_numpy(int) - first, rows["at"].to_numpy(int)] = rows["ret"].to_numpy(float)
    return first, x


def scores(returns: DataFrame, cal: DataFrame, window: int, decays: tuple[float, ...] = GRID, ridge: float = 1e-8, least: int = 30, diagonal: bool = False, block: int | None = None) -> DataFrame:
    """decay, score, n: the mean quasi-likelihood over the n dates that have `least` returns and a definite state.

    returns: date, asset, ret; cal: date, idx from 0. The first state is the covariance of the first `window` dates, or its
    diagonal. Decays outside [0.8, 1) are left out; a decay without any date scores null.
    """
    spark = returns.sparkSession
    decays = tuple(float(d) for d in decays if 0.8 <= d < 1)
    names = sorted(r["asset"] for r in returns.select("asset").distinct().collect())
    last = cal.agg(F.max("idx")).first()[0]
    kind = "decay double, score double, n long"
    if not decays or not names or last is None or last <= window:
        return spark.createDataFrame([(d, None, 0) for d in decays], kind)
    size, span = len(names), block or max(2 * window, 64)
    # Both matrices need the whole universe, so its names are few enough to send along.
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("asset")) - 1
    rows = returns.join(cal.select("date", "idx"), "date").select(F.col("idx").cast("int").alias("idx"), place.cast("int").alias("at"), F.col("ret").cast("double").alias("ret"))
    rows = stored(rows, "decay-rows")
    # A date is scored in its own block and lies in the windows of the dates up to `window` later.
    of = lambda t: F.floor((t - (window + 1)) / span).cast("int")
    spread = F.explode(F.sequence(of(F.greatest(F.col("idx"), F.lit(window + 1))), of(F.least(F.col("idx") + window, F.lit(last)))))
    blocks = rows.filter(F.col("idx") >= 1).withColumn("block", spread).union(rows.filter(F.col("idx") < window).withColumn("block", F.lit(-1)))
    packs = [list(decays[k : k + TOGETHER]) for k in range(0, len(decays), TOGETHER)]
    dealt = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(len(packs) - 1))))

    def moves(first: int, x: np.ndarray, number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The covariance before each date of a block, and its returns."""
        start = window + 1 + number * span
        for t in range(start, min(start + span, last + 1)):
            own = x[max(t - window - first, 0) : max(t - first, 0)]
            yield paired_covariance(own) if len(own) else np.zeros((size, size)), x[t - first] if 0 <= t - first < len(x) else np.full(size, np.nan)

    def collect(key, rows: pd.DataFrame) -> pd.DataFrame:
        """What a block adds to the state of each decay, a row of the matrix at a time."""
        own = np.array(packs[key[1]])
        first, x = _panel(rows, size)
        if key[0] < 0:
            s = paired_covariance(x)
            total = np.repeat((np.diag(np.diag(s)) if diagonal else s)[None], len(own), axis=0)
        else:
            total = np.zeros((len(own), size, size))
            for c, _ in moves(first, x, key[0]):
                total = own[:, None, None] * total + (1 - own)[:, None, None] * c
        return pd.DataFrame({"pack": key[1], "decay": np.repeat(own, size), "block": key[0], "i": np.tile(np.arange(size), len(own)), "v": list(total.reshape(-1, size))})

    parts = dealt.groupBy("block", "pack").applyInPandas(collect, "pack int, decay double, block int, i int, v array<double>")

    def scan(key, rows: pd.DataFrame) -> pd.DataFrame:
        """One row of the state before each block."""
        rows = rows.sort_values("block")
        state, out, factor = np.zeros(size), [], key[0] ** span
        for number, v in zip(rows["block"], rows["v"], strict=True):
            state = factor * state + np.asarray(v)
            out.append((int(rows["pack"].iloc[0]), key[0], number + 1, key[1], state))
        return pd.DataFrame(out, columns=["pack", "decay", "block", "i", "v"])

    states = parts.groupBy("decay", "i").applyInPandas(scan, "pack int, decay double, block int, i int, v array<double>")

    def score(key, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        own = np.array(packs[key[1]])
        if key[0] < 0 or not len(rows) or not len(before):
            return pd.DataFrame({"decay": [], "total": [], "n": []})
        first, x = _panel(rows, size)
        before = before.sort_values(["decay", "i"])
        state = np.array(before["v"].tolist(), float).reshape(len(own), size, size)
        total, n = np.zeros(len(own)), np.zeros(len(own), int)
        for c, r in moves(first, x, key[0]):
            state = own[:, None, None] * state + (1 - own)[:, None, None] * c
            one = likelihood(state, r, ridge, least)
            total, n = total + np.nan_to_num(one), n + np.isfinite(one)
        return pd.DataFrame({"decay": own, "total": total, "n": n})

    found = dealt.groupBy("block", "pack").cogroup(states.groupBy("block", "pack")).applyInPandas(score, "decay double, total double, n long")
    n = F.sum("n")
    return found.groupBy("decay").agg(F.when(n > 0, F.sum("total") / n).alias("score"), n.alias("n"))


def tune(scored: DataFrame, current: float, dates: int, window: int) -> float:
    """The decay of highest score, of equals the lowest; the current one if no more than window + 5 dates are there."""
    if dates <= window + 5:
        return current
    best = scored.orderBy(F.desc_nulls_last("score"), "decay").first()
    return current if best is None else float(best["decay"])
