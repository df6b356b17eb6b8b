"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

A node's children are digests of 64 hexadecimal characters, which is one block of SHA-256. So the hash
of a parent passes through one state before each child, and parents retain these states. To fold another
digest into a parent, the state before its slot is resumed with the replacement and the siblings to the
right; what stands to the left is not hashed again. Compression runs on many parents at once, in numpy.

Leaves are numbered within their group by a sort that every task shares and by counts of its parts, so no
task holds a group. A level of the tree is one table, sixteen times smaller than the one below. Paths to
the root come down from the top, level by level, each node meeting its parent; the leaves of one lowest
parent (sixteen at most) are folded together.

Defined results: a null field counts as `-`, so null and empty texts differ; null keys come first; rows
that share a key stand in order of their leaves, repeated rows have equal leaves and each has a slot; a
leaf that is alone is its own subroot; an empty table gives an empty table; extra columns are not
carried, whatever their names; texts of any length are hashed by built-in functions and go nowhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from trackline.llm.common import discard, materialise

ARITY = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _root_bits(degree: int, count: int) -> list[int]:
    """The first 32 bits behind the point of the roots of the first primes: the constants of SHA-256."""
    primes, out = [], []
    k = 2
    while len(primes) < count:
        if all(k % p for p in primes):
            primes.append(k)
        k += 1
    for p in primes:
        goal, low, high = p << (32 * degree), 0, p << 32
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid**degree <= goal else (low, mid - 1)
        out.append(low & 0xFFFFFFFF)
    return out


_ROUND = np.array(_root_bits(3, 64), np.uint32)
_START = np.array(_root_bits(2, 8), np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256's compression of one block (16 words x rows) into each state (8 words x rows)."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _padding(blocks: np.ndarray) -> np.ndarray:
    """The last block of messages of so many whole blocks."""
    out = np.zeros((16, len(blocks)), np.uint32)
    out[0], out[15] = 1 << 31, blocks * 512
    return out


def _hex(states: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(states.T).astype(">u4").tobytes().hex()
    return [raw[i : i + 64] for i in range(0, len(raw), 64)]


def _words(digests: list[str]) -> np.ndarray:
    """Digests as hex text, as blocks."""
    return np.frombuffer("".join(digests).encode(), ">u4").reshape(-1, 16).T.astype(np.uint32)


def _children(kids: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each parent's children (16 words x rows x slots), and how many there are."""
    count = np.array([len(k) // 64 for k in kids])
    words = np.zeros((len(kids), ARITY, 16), np.uint32)
    words[np.arange(ARITY) < count[:, None]] = _words(kids).T
    return np.moveaxis(words, 2, 0), count


def midstates(kids: list[str]) -> tuple[list[str], list[bytes]]:
    """The digest of each parent, and the states before its slots, 32 bytes each."""
    blocks, count = _children(kids)
    state = np.repeat(_START[:, None], len(kids), axis=1)
    kept = np.zeros((len(kids), ARITY, 8), ">u4")
    for s in range(ARITY):
        kept[:, s] = state.T
        rows = np.flatnonzero(count > s)
        if len(rows):
            state[:, rows] = compress(state[:, rows], blocks[:, rows, s])
    return _hex(compress(state, _padding(count))), [k[:n].tobytes() for k, n in zip(kept, count, strict=True)]


def resume(digests: list[str], slots: np.ndarray, kids: list[str], states: list[bytes], owner: np.ndarray) -> list[str]:
    """The digests of parents in which another digest takes a slot; owner says which parent each row has."""
    blocks, count = _children(kids)
    count = count[owner]
    own = np.stack([np.frombuffer(states[o], ">u4", 8, 32 * s) for o, s in zip(owner.tolist(), slots.tolist(), strict=True)]).T.astype(np.uint32)
    new = _words(digests)
    for s in range(ARITY):
        rows = np.flatnonzero((slots <= s) & (count > s))
        if len(rows):
            block = np.where(slots[rows] == s, new[:, rows], blocks[:, owner[rows], s])
            own[:, rows] = compress(own[:, rows], block)
    return _hex(compress(own, _padding(count)))


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def number(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with idx (from 0, in order within its group) and n (rows of the group).

    Rows are sorted in ranges, with the place of a row as the last key so that equal ones can be split,
    and written. A range then needs only the counts of the ranges before it.
    """
    keys = [group, *order, "place"]
    rows = df.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "merkle-leaves")
    rows = rows.withColumn("part", F.shiftright("place", 33))
    parts = rows.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(Window.partitionBy(group)).alias("n"))
    out = rows.join(parts, [group, "part"]).withColumn("idx", F.col("start") + F.col("place") - F.col("first"))
    return out.drop("part", "place", "first", "start")


@F.pandas_udf(StructType().add("digest", StringType()).add("states", BinaryType()))
def _hash_parents(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for kids in batches:
        digest, states = midstates(kids.tolist()) if len(kids) else ([], [])
        yield pd.DataFrame({"digest": digest, "states": states})


def _parents(nodes: DataFrame, label: str, more: list[str] = ()) -> DataFrame:
    """One level up: grp, idx, n of the parents' level, kids (the children's digests in one text), digest, states.

    nodes: grp, idx, n, digest. A group of one node stays as it is: it gets no states. `more` are columns of
    the nodes to keep, as arrays in order of the slots.
    """
    slot = F.struct((F.col("idx") % ARITY).cast("int").alias("slot"), "digest", *more)
    up = nodes.groupBy("grp", "n", F.floor(F.col("idx") / ARITY).cast("long").alias("idx")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    up = up.select("grp", "idx", "n", F.array_join(F.col("slots.digest"), "").alias("kids"), *[F.col(f"slots.{c}").alias(c) for c in more])
    # A group of one node is no parent: its only node passes through.
    up = up.withColumn("made", _hash_parents("kids"))
    alone = F.col("n") == 1
    return materialise(
        up.select("grp", "idx", F.ceil(F.col("n") / ARITY).cast("long").alias("n"), alone.alias("alone"), "kids",
                  F.when(alone, F.col("kids")).otherwise(F.col("made.digest")).alias("digest"), F.col("made.states").alias("states"), *more),
        label,
    )


@dataclass
class Tree:
    """The levels of all groups from the lowest parents up, and the group's last digest."""

    levels: list[DataFrame]
    roots: DataFrame

    def discard(self) -> None:
        discard(*self.levels)


def build(nodes: DataFrame, label: str, more: list[str] = ()) -> Tree:
    """The trees of all groups of nodes (grp, idx, n, digest); the roots are grp, digest.

    The lowest level keeps groups of one node too; higher levels hold groups of several nodes only.
    """
    levels = [_parents(nodes, label, list(more))]
    # The most nodes of one group tell how many levels follow.
    left = levels[0].agg(F.max("n")).first()[0] or 0
    while left > 1:
        levels.append(_parents(levels[-1].filter("n > 1").select("grp", "idx", "n", "digest"), label))
        left = -(-left // ARITY)
    return Tree(levels, reduce(DataFrame.union, [x.filter("n = 1").select("grp", "digest") for x in levels]))


#: The way of a node up to the root: its slot at each level, and the children and states of each parent.
_WAY = {"at_slots": "int", "at_kids": "string", "at_states": "binary"}


def _longer(slot: Column, kids: Column, states: Column) -> list[Column]:
    """A parent's way, with a slot in that parent before it."""
    return [F.concat(F.array(x), F.col(c)).alias(c) for c, x in zip(_WAY, (slot.cast("int"), kids, states), strict=True)]


def _lowest(tree: Tree, tops: DataFrame) -> DataFrame:
    """The lowest parents with their ways. tops: grp, the way of its root, and what else to carry down."""
    carried = [c for c in tops.columns if c != "grp" and c not in _WAY]
    above = None
    for level in reversed(tree.levels):
        here = level.filter("n = 1").join(tops, "grp").select(*level.columns, *carried, *_WAY)
        if above is not None:
            way = above.select("grp", F.col("idx").alias("parent"), F.col("kids").alias("up_kids"), F.col("states").alias("up_states"), *carried, *_WAY)
            met = level.filter("n > 1").withColumn("parent", F.floor(F.col("idx") / ARITY).cast("long")).join(way, ["grp", "parent"])
            here = here.union(met.select(*level.columns, *carried, *_longer(F.col("idx") % ARITY, F.col("up_kids"), F.col("up_states"))))
        above = here
    return above


@F.pandas_udf(StructType().add("folded", ArrayType(StringType())).add("proof", ArrayType(StringType())))
def _fold_units(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """For each lowest parent: what each of its leaves folds to at the root, and the hash of its siblings."""
    for alone, kids, states, new, slots, at_kids, at_states in batches:
        if not len(alone):
            yield pd.DataFrame({"folded": [], "proof": []})
            continue
        alone, kids, states = alone.tolist(), kids.tolist(), states.tolist()
        counts = np.array([len(x) for x in new])
        owner = np.repeat(np.arange(len(kids)), counts)
        place = np.concatenate([np.arange(c) for c in counts])
        digests = [d for x in new for d in x]
        # One leaf alone has no parent: it goes straight on.
        live = np.flatnonzero(~np.array(alone)[owner])
        if len(live):
            for j, d in zip(live.tolist(), resume([digests[j] for j in live], place[live], kids, states, owner[live]), strict=True):
                digests[j] = d
        depth = np.array([len(s) for s in slots])
        for level in range(depth.max()):
            some = np.flatnonzero(depth > level)
            at = np.full(len(kids), -1)
            at[some] = np.arange(len(some))
            live = np.flatnonzero(at[owner] >= 0)
            up = resume([digests[j] for j in live], np.array([slots.iloc[k][level] for k in some])[at[owner[live]]], [at_kids.iloc[k][level] for k in some], [bytes(at_states.iloc[k][level]) for k in some], at[owner[live]])
            for j, d in zip(live.tolist(), up, strict=True):
                digests[j] = d
        folded, proof, first = [], [], 0
        for k, count in enumerate(counts.tolist()):
            upper = "".join(x[: 64 * s] + x[64 * s + 64 :] for s, x in zip(slots.iloc[k].tolist(), at_kids.iloc[k], strict=True)).encode()
            own = [b"" if alone[k] else (kids[k][: 64 * i] + kids[k][64 * i + 64 :]).encode() for i in range(count)]
            proof.append([hashlib.sha256(o + upper).hexdigest() for o in own])
            folded.append(digests[first : first + count])
            first += count
        yield pd.DataFrame({"folded": folded, "proof": proof})


def manifest(docs: DataFrame, columns: list[str], changed: dict[str, Column] | None = None, where: Column | None = None, key: str = "doc_id", group: str = "source") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf hashes `columns`. Where `where` is true, what is verified is the row with the columns `changed`;
    folded_root is the root that it leads to. verified tells whether that is the stored root.
    """
    told = leaf([F.col(c) for c in columns])
    other = leaf([(changed or {}).get(c, F.col(c)) for c in columns])
    doubtful = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    # Null first, then bytewise, as Spark orders texts.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(grp.alias("grp"), F.col(key).alias("id"), told.alias("digest"), F.when(doubtful, other).alias("other"))
    nodes = number(rows, "grp", ["id", "digest"])
    tree = build(nodes, "merkle-group", ["id", "other"])
    tops = number(tree.roots.select(F.lit("").alias("all"), F.col("grp").alias("source"), "digest"), "all", ["source"])
    top = build(tops.select(F.col("all").alias("grp"), "idx", "n", "digest", "source"), "merkle-top", ["source"])
    ends = top.roots.select("grp", F.col("digest").alias("root"), *[F.expr(f"cast(array() AS array<{t}>)").alias(c) for c, t in _WAY.items()])
    # The way of each source's root: its slot among the sources, then up.
    ways = _lowest(top, ends).select("alone", "kids", "states", "root", *_WAY, F.posexplode("source").alias("place", "of"))
    subroot = F.substring("kids", F.col("place") * 64 + 1, F.lit(64)).alias("subroot")
    none = F.col("alone")
    ways = ways.select(F.col("of").alias("grp"), subroot, "root", *[F.when(none, F.col(c)).otherwise(x).alias(c) for c, x in zip(_WAY, _longer(F.col("place"), F.col("kids"), F.col("states")), strict=True)])
    units = _lowest(tree, ways)
    leaves = F.transform(F.sequence(F.lit(0), F.size("id") - 1), lambda i: F.substring("kids", i * 64 + 1, F.lit(64)))
    units = units.withColumn("leaf", leaves)
    new = F.zip_with("leaf", "other", lambda a, b: F.coalesce(b, a))
    units = units.withColumn("done", _fold_units("alone", "kids", "states", new, *_WAY))
    each = units.select("subroot", "root", F.explode(F.arrays_zip("id", "leaf", F.col("done.folded").alias("folded"), F.col("done.proof").alias("proof"))).alias("x"))
    return each.select(
        F.col("x.id").alias(key), F.col("x.leaf").alias("leaf"), "subroot", "root", F.col("x.proof").alias("proof_sha256"),
        F.col("x.folded").alias("folded_root"), (F.col("x.folded") == F.col("root")).alias("verified"),
    )
