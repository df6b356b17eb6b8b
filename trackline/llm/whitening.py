"""Whitening of embeddings by refined eigenvectors of their covariance.

Entries become whole numbers, whose sums are exact. Tasks add up products of centred vectors, and one row
of the covariance matrix after another is merged. Its eigenvectors are found in 32-bit floats and corrected
by the iteration of Ogita and Aishima, which needs matrix products only, in the widest float that numpy has;
where eigenvalues lie too close together for the present accuracy, the block of their vectors is solved by
itself and turned. Another pass measures how far the covariance of the result is from the identity.

The matrices that reach the driver have as many rows and columns as a vector has entries.

Defined results: vectors that are null or empty, that hold null or non-finite entries or entries whose
64-fold is no long, take no part, nor do those of another length than most (of equally common lengths the
longer counts); zero vectors, repeated rows and null ids do; a deviation beyond a long is null; a component
along which the vectors don't vary, as far as a double can tell, has null for `whitened` and is left out of
identity_error, which is null without any component; without any variance explained is null; an empty table
gives an empty table; extra columns are not carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rounds of refinement, at most; it converges quadratically and stops by itself.
ROUNDS = 12
#: Tasks that merge rows of a matrix, at most.
MERGERS = 64
_SAFE = 2.0**62


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v (array of doubles) of the vectors that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    # Not a number compares as greater than all numbers.
    rows = rows.filter("size(v) > 0").filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < (2.0**63 - 2.0**20) / SCALE)))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (most[0]["d"] if most else 0))


def whole(vectors: pd.Series) -> np.ndarray:
    """The entries as whole numbers, a vector a row."""
    return np.floor(SCALE * np.stack(vectors.to_numpy()).astype(float)).astype(np.int64) + SHIFT


def _far(x: np.ndarray) -> float:
    """The largest absolute value, as a float."""
    return float(np.abs(x.astype(float)).max(initial=0))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0
        for batch in batches:
            if len(batch):
                x = whole(batch["v"])
                x = x if _far(x) * len(x) < _SAFE else x.astype(object)
                n, total = n + len(x), total + x.sum(axis=0).astype(object)
        if n:
            yield pd.DataFrame({"i": range(len(total)), "n": n, "s": [str(t) for t in total]})

    parts = rows.select("v").mapInPandas(add, "i int, n long, s string")
    told = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (told[0]["n"], [int(r["s"]) for r in told]) if told else (0, [])


class Centre:
    """Vectors less their mean: first less its whole part, which is exact, then less the rest."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, np.array(total, object)
        self.base = np.array([t // n for t in total], np.int64)
        self.rest = np.array([(t % n) / n for t in total], float)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n x - S)^2."""
        near, left = x - self.base, self.total - self.n * np.array(self.base.tolist(), object)
        size = float(self.n) * (_far(near) + 1)
        if size * size * x.shape[1] < _SAFE:
            return np.square(self.n * near - left.astype(np.int64)).sum(axis=1).tolist()
        exact = ((self.n * near.astype(object) - left) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact.tolist()]


def covariance(rows: DataFrame, points: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The covariance matrix of points(whole vectors), divisor n.

    Each task centres what it holds before multiplying; parts are merged with their means.
    """

    def merge(a: tuple, b: tuple) -> tuple:
        """n, mean and products of two parts together; products may be one row of them (with its place)."""
        (n, mean, m, i), (k, other, p, _) = a, b
        off = other - mean
        mine = off if i is None else off[i : i + 1]
        return n + k, mean + off * (k / (n + k)), m + p + np.multiply.outer(mine, off).reshape(m.shape) * (n * k / (n + k)), i

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if len(batch):
                y = points(whole(batch["v"]))
                mean = y.mean(axis=0)
                part = (len(y), mean, (y - mean).T @ (y - mean), None)
                held = part if held is None else merge(held, part)
        if held is not None:
            n, mean, m, _ = held
            yield pd.DataFrame({"i": range(len(mean)), "n": n, "mean": [mean] * len(mean), "m": list(m)})

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for i, n, mean, m in batch[["i", "n", "mean", "m"]].itertuples(index=False):
                part = (n, np.asarray(mean), np.asarray(m), i)
                held[i] = merge(held[i], part) if i in held else part
        if held:
            yield pd.DataFrame({"i": list(held), "v": [m / n for n, _, m, _ in held.values()]})

    parts = rows.select("v").mapInPandas(gather, "i int, n long, mean array<double>, m array<double>")
    told = parts.repartition(MERGERS, "i").mapInPandas(collect, "i int, v array<double>").orderBy("i").collect()
    v = np.array([r["v"] for r in told], float)
    return (v + v.T) / 2


def eigenpairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    size = np.abs(v).max(initial=0)
    if size == 0:
        return np.zeros(len(v)), np.eye(len(v))
    wide = np.longdouble
    a = (v / size).astype(wide)
    x = np.linalg.eigh((v / size).astype(np.float32))[1].astype(wide)
    eye, values = np.eye(len(v), dtype=wide), np.zeros(len(v), wide)
    for _ in range(ROUNDS):
        r, s = eye - x.T @ x, x.T @ a @ x
        # Rounding makes it lopsided, and narrow gaps would magnify that.
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        # What the vectors can't tell apart yet.
        blur = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > blur
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ step
        order = np.argsort(values)
        near = np.split(order, np.flatnonzero(np.diff(values[order]) > blur) + 1)
        for block in [b for b in near if len(b) > 1]:
            own = x[:, block]
            own = own @ (3 * np.eye(len(block), dtype=wide) - own.T @ own) / 2
            part = own.T @ a @ own
            part = (part + part.T) / 2 - np.eye(len(block), dtype=wide) * np.diag(part).mean()
            scale = np.abs(part).max()
            if scale > 0:
                own = own @ np.linalg.eigh((part / scale).astype(float))[1].astype(wide)
            x[:, block] = own
        if np.abs(step).max() < 1e-17:
            break
    x = x @ (3 * eye - x.T @ x) / 2
    values = np.diag(x.T @ a @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(np.square(x[:, order]).sum(axis=0))
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(v))])
    return (values[order] * wide(size)).astype(float), x.astype(float)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component."""
    rows = usable(vectors, vec_id, vector)
    n, total = sums(rows)
    centre = Centre(n, total) if n else None
    values, axes = eigenpairs(covariance(rows, centre)) if n else (np.zeros(0), np.zeros((0, 0)))
    k = min(components, len(values))
    # Rounding leaves eigenvalues of about this size where there is no variance.
    flat = values[:k] <= values.max(initial=0) * len(values) * 2.0**-50
    turn = axes[:, :k] / np.sqrt(np.where(flat, 1, values[:k]))
    trace = values.sum()
    explained = [float(e / trace) if trace > 0 else None for e in np.maximum(values[:k], 0)]
    live = np.flatnonzero(~flat)
    error = float(np.abs(covariance(rows, lambda x: centre(x) @ turn[:, live]) - np.eye(len(live))).max()) if len(live) else None

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"deviation": [], "whitened": []}, dtype=object)
                continue
            x = whole(batch)
            yield pd.DataFrame({"deviation": pd.Series(centre.deviation(x), dtype="Int64"), "whitened": list(centre(x) @ turn)})

    each = rows.select("vec_id", project("v").alias("p")).select("vec_id", "p.deviation", F.posexplode("p.whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(e).cast("double") for e in explained]) if explained else F.expr("cast(array() AS array<double>)")
    varies = F.col("at").isin(live.tolist()) if len(live) < k else F.lit(True)
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(varies, F.col("whitened")).alias("whitened"),
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
