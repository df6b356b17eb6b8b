"""Nearest neighbours by multi-index hashing.

A rotation is learned on a bounded sample so that the signs of the rotated components (one bit each) lose
little (iterative quantisation). A code is cut into eight substrings, each with an index of its own. A
code within Hamming radius r of a query agrees with it in some substring up to a share of r, so probing
these small radii finds every code within r (pigeonhole). What lies within r is ranked anew by exact
inner products in double precision. The radius is set on the sample so that it holds most true
neighbours, and grows for a query that has found fewer than asked.

Spark deals the vectors into shards and the queries into blocks; a task searches one shard for one block,
and only its best rows leave it. Equal vectors of a shard are one entry with their smallest ids, so that a
vector that a third of all rows share is searched once.

Sample bound: SAMPLE vectors, the ones with the smallest hash of their id. Every vector is indexed.

Defined results: vectors that are null, zero, of another length than most, or that hold nulls or
non-finite numbers take no part; ties go to the smaller id; rows with the query's own id are not its
neighbours; of rows that share an id one is the query; vectors with a null id take no part; with
fewer candidates than asked all are returned; an empty table gives an empty table; extra columns are not
carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that the rotation and the radius are learned on, at most.
SAMPLE = 8192
BITS, PARTS = 64, 8
#: Rows of a shard and of a query block, at most on average.
SHARD, QUERIES = 65_536, 4096
#: Share of the sample's true neighbours that the radius must hold.
RECALL = 0.97

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NEAR = [np.flatnonzero(_POP <= r).astype(np.uint8) for r in range(9)]


def valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v (array of doubles) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").filter(finite)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def learn(sample: np.ndarray, k: int, total: int, rounds: int = 30) -> tuple[np.ndarray, int]:
    """Rotation to BITS components, and the radius that holds RECALL of the k nearest."""
    rng, dims = np.random.default_rng(5), sample.shape[1]
    if dims > BITS:
        _, _, axes = np.linalg.svd(sample, full_matrices=False)
        base = [axes[:BITS].T]
    else:
        base = [np.eye(dims)] * math.ceil(BITS / dims)
    made = []
    for b in base:
        x = sample @ b
        turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(x @ turn).T @ x)
            turn = (u @ w).T
        made.append(b @ turn)
    rotation = np.hstack(made)[:, :BITS]
    if rotation.shape[1] < BITS:
        rotation = np.hstack([rotation, np.zeros((dims, BITS - rotation.shape[1]))])
    # The k nearest of all are the nearest k * len(sample) / total of the sample, one at least.
    near = max(1, min(len(sample) - 1, round(k * len(sample) / max(total, 1))))
    if len(sample) < 3:
        return rotation, BITS
    ask = np.arange(0, len(sample), max(1, len(sample) // 256))
    score = sample[ask] @ sample.T
    score[np.arange(len(ask)), ask] = -np.inf
    best = np.argpartition(-score, near - 1, axis=1)[:, :near]
    codes = encode(sample, rotation)
    far = _POP[codes[ask][:, None] ^ codes[best]].sum(axis=2)
    return rotation, int(min(BITS, np.quantile(far, RECALL, method="higher") + 1))


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of PARTS bytes."""
    return np.packbits(vectors @ rotation > 0, axis=1)


class _Index:
    """One shard: codes, and for each substring the rows in order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = np.ascontiguousarray(codes).view(np.uint64).ravel()
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(PARTS)]
        self.first = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows of every code within the radius."""
        share, more = divmod(radius, PARTS)
        seen = np.zeros(len(self.codes), bool)
        for s in range(PARTS):
            r = share if s <= more else share - 1
            if r < 0:
                continue
            order, first = self.order[s], self.first[s]
            for value in (code[s] ^ _NEAR[min(r, 8)]).tolist():
                seen[order[first[value] : first[value + 1]]] = True
        rows = np.flatnonzero(seen)
        far = np.bitwise_count(self.words[rows] ^ np.ascontiguousarray(code).view(np.uint64)[0])
        return rows[far <= radius]


def _search(entries: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, names: np.ndarray, rotation: np.ndarray, radius: int, k: int) -> Iterator[tuple[int, int, float]]:
    index = _Index(encode(entries, rotation))
    codes = encode(queries, rotation)
    smallest = np.array([i[0] for i in ids])
    for q, name, code in zip(queries, names, codes, strict=True):
        r = radius
        while True:
            rows = index.within(code, r)
            if len(rows) > k or r >= BITS:
                break
            r = min(BITS, r + 4)
        # One product at a time in one order, so that equal vectors score alike in every shard.
        score = (entries[rows] * q).sum(axis=1)
        if len(rows) > 2 * k:
            limit = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            rows, score = rows[score >= limit], score[score >= limit]
        found = []
        for j in np.lexsort((smallest[rows], -score)):
            if len(found) > k and score[j] < found[-1][2]:
                break
            found += [(int(name), int(i), float(score[j])) for i in ids[rows[j]] if i != name]
        found.sort(key=lambda x: (-x[2], x[1]))
        yield from found[:k]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product to each row for which `queries`, a
    condition on `id`, is true."""
    rows = valid(vectors, vec_id, vector)
    spark = vectors.sparkSession
    total = rows.count()
    told = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    kinds = "query_id long, vec_id long, score double"
    if not told:
        return spark.createDataFrame([], kinds).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    rotation, radius = learn(np.array([r["v"] for r in told], float), k, total)
    shards = max(math.ceil(total / SHARD), min(24, math.ceil(total / 512)))
    asked = rows.filter(queries).dropDuplicates(["id"])
    blocks = max(1, math.ceil(asked.count() / QUERIES))

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard")).select("id", "v", "shard", every(blocks, "block"))
    right = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).select("id", "v", "block", every(shards, "shard"))

    def search(index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = index.sort_values("id", kind="stable")
        v, at = np.unique(np.array(index["v"].tolist(), float), axis=0, return_inverse=True)
        at = at.ravel()
        order = np.argsort(at, kind="stable")
        # Of equal vectors only the k + 1 smallest ids can be among the k nearest of a query.
        ids = [g[: k + 1] for g in np.split(index["id"].to_numpy(np.int64)[order], np.cumsum(np.bincount(at))[:-1])]
        found = _search(v, ids, np.array(ask["v"].tolist(), float), ask["id"].to_numpy(np.int64), rotation, radius, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, kinds)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
