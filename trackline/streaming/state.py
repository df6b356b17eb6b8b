"""Online covariance models whose state can be stored, restored and gone on from.

A model is a start, a step and the covariance that a state stands for. A stream keeps one state a key, as one binary
value, and hands out what it is after each batch. These rows make a snapshot: a table that another stream takes as
its first states. Snapshots carry the model's name and a version; a state of another model or version is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

VERSION = 1
STATE = StructType().add("kind", StringType()).add("version", LongType()).add("seq", LongType()).add("size", LongType()).add("state", BinaryType())


@dataclass(frozen=True)
class Ewma:
    """S' = decay S + (1 - decay) r r', from zero; missing returns count as zero."""

    decay: float = 0.94

    @property
    def kind(self) -> str:
        return f"ewma/{self.decay!r}"

    def start(self, size: int) -> np.ndarray:
        return np.zeros(size * size)

    def step(self, state: np.ndarray, r: np.ndarray) -> np.ndarray:
        r = np.nan_to_num(r)
        return self.decay * state + (1 - self.decay) * np.outer(r, r).ravel()

    def covariance(self, state: np.ndarray, size: int) -> np.ndarray:
        return state.reshape(size, size)


@dataclass(frozen=True)
class Expanding:
    """The sample covariance of all returns so far; a date with a missing return is left out, and one date has zeros."""

    kind: str = "expanding"

    def start(self, size: int) -> np.ndarray:
        return np.zeros(1 + size + size * size)

    def step(self, state: np.ndarray, r: np.ndarray) -> np.ndarray:
        if not np.isfinite(r).all():
            return state
        n, size = state[0] + 1, len(r)
        off = r - state[1 : size + 1]
        mean = state[1 : size + 1] + off / n
        return np.concatenate([[n], mean, state[size + 1 :] + np.outer(off, r - mean).ravel()])

    def covariance(self, state: np.ndarray, size: int) -> np.ndarray:
        m = state[size + 1 :].reshape(size, size)
        return (m + m.T) / 2 / max(state[0] - 1, 1)


class _Processor(StatefulProcessor):
    def __init__(self, model, size: int):
        self.model, self.size = model, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("covariance", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.sort_values("seq").iloc[-1]
        self._checked(row["kind"], row["version"], row["size"])
        self.held.update((row["kind"], int(row["version"]), int(row["seq"]), int(row["size"]), bytes(row["state"])))

    def _checked(self, kind: str, version: int, size: int) -> None:
        if (kind, int(version), int(size)) != (self.model.kind, VERSION, self.size):
            raise ValueError(f"a state of {kind}, version {version}, size {size} is not one of {self.model.kind}, version {VERSION}, size {self.size}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, state = -(2**63), self.model.start(self.size)
        if self.held.exists():
            kind, version, seq, size, raw = self.held.get()
            self._checked(kind, version, size)
            state = np.frombuffer(raw, float)
        # One micro-batch of one key: as large as the trigger lets it be.
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for r in batch.itertuples(index=False):
            if r.seq <= seq:
                # Seen before, as after a restart from a snapshot that is ahead of the source.
                continue
            state, seq = self.model.step(state, np.asarray(r.r, float)), r.seq
            s = self.model.covariance(state, self.size)
            out.append([key[0], r.seq, float(np.trace(s)), float(np.linalg.norm(s)), None, None, None, None])
        if out:
            raw = np.ascontiguousarray(state, float).tobytes()
            self.held.update((self.model.kind, VERSION, int(seq), self.size, raw))
            out[-1][4:] = [self.model.kind, VERSION, self.size, raw]
        names = ["model", "seq", "trace", "frobenius", "kind", "version", "size", "state"]
        yield pd.DataFrame(out, columns=names) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in names})

    def close(self) -> None:
        pass


_OUT = StructType().add("model", StringType()).add("seq", LongType()).add("trace", DoubleType()).add("frobenius", DoubleType()).add("kind", StringType()).add("version", LongType()).add("size", LongType()).add("state", BinaryType())


def updates(vectors: DataFrame, model: Ewma | Expanding, size: int, snapshot: DataFrame | None = None) -> DataFrame:
    """model, seq, trace, frobenius after each vector (model, seq, r of `size` numbers) of a stream; the last row of a batch
    also holds the state (kind, version, size, state).

    Vectors come in the order of seq over batches; within a batch they are sorted, and a seq that a key has
    passed is skipped. snapshot: a table made by snapshots(); its keys go on from there.
    """
    first = None if snapshot is None else snapshot.select("model", *STATE.names).groupBy("model")
    return vectors.groupBy("model").transformWithStateInPandas(_Processor(model, size), _OUT, "append", "none", first)


def snapshots(results: DataFrame) -> DataFrame:
    """model, kind, version, seq, size, state: the last state of each key in a table of results."""
    rows = results.filter("state IS NOT NULL").groupBy("model").agg(F.max_by(F.struct(*STATE.names), "seq").alias("s"))
    return rows.select("model", "s.*")


def matrices(snapshot: DataFrame, model: Ewma | Expanding) -> DataFrame:
    """model, seq, i, j, cov (i <= j, places in the vector) of the states of a snapshot."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                size = int(r.size_)
                s = model.covariance(np.frombuffer(r.state, float), size)
                i, j = np.triu_indices(size)
                yield pd.DataFrame({"model": r.model, "seq": r.seq, "i": i, "j": j, "cov": s[i, j]})

    return snapshot.select("model", "seq", F.col("size").alias("size_"), "state").mapInPandas(unpack, "model string, seq long, i int, j int, cov double")
