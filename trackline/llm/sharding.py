"""Shards by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight, u being a hash
of the key and the child's path, and the smallest draw wins; a child's weight is the sum of its shards'.
Other children's draws do not depend on a child's weight, so raising a weight only moves keys into that
subtree and lowering it only moves keys out of it: keys elsewhere stay. A new shard opens a region of its
own, so that one more shard takes rows only into itself. Built-in functions only.

Defined results: a null key is a key like any other; equal keys share a shard; an empty table gives an
empty table; added columns replace columns with their names, and
columns named _slot_block, _slot_row and _slot_first go.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import materialise

#: Blocks of slot numbers in each shard: 4096 x shards counts are a table of bounded size.
SLOT_BLOCKS = 4096


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int, start: int = 8) -> list[Shard]:
    """The first `start` shards stand two to a rack, four to a region; each later one opens a region."""
    return [Shard(i, f"region{i // 4}", f"rack{i % 4 // 2}") if i < start else Shard(i, f"region+{i}", "rack0") for i in range(shards)]


def _draw(keys: list[Column], path: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(path), *keys), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def shard_of(keys: list[Column], shards: Iterable[Shard]) -> Column:
    """The shard number that the keys descend to."""

    def descend(nodes: list[Shard], levels: list[str], path: str) -> Column:
        if not levels:
            return F.lit(nodes[0].number)
        children: dict[str, list[Shard]] = {}
        for s in nodes:
            children.setdefault(str(getattr(s, levels[0])), []).append(s)
        below = {name: descend(own, levels[1:], f"{path}/{name}") for name, own in children.items()}
        if len(children) == 1:
            return next(iter(below.values()))
        names = list(children)
        draws = [F.struct(_draw(keys, f"{path}/{n}", sum(s.weight for s in children[n])).alias("d"), F.lit(k).alias("k")) for k, n in enumerate(names)]
        won = F.array_min(F.array(*draws))["k"]
        return F.element_at(F.array(*below.values()), won + 1) if len(levels) == 1 else _choose(won, list(below.values()))

    live = [s for s in shards if s.weight > 0]
    return descend(live, ["region", "rack", "number"], "").cast("int")


def _choose(index: Column, options: list[Column]) -> Column:
    out = F.when(index == 0, options[0])
    for k, option in enumerate(options[1:], 1):
        out = out.when(index == k, option)
    return out


def assign(df: DataFrame, keys: list[str], shards: Iterable[Shard], to: str = "shard") -> DataFrame:
    """Add the shard of each row. No shuffle."""
    return df.withColumn(to, shard_of([F.col(k) for k in keys], shards))


def number_slots(df: DataFrame, keys: list[str], shard: str = "shard", to: str = "slot") -> DataFrame:
    """Add gapless numbers from 0 in each shard.

    Rows are numbered in hashed blocks of a shard, and blocks start where the counts of earlier ones
    end, so that no task holds a shard. The block is a hash of the keys and of the row's place, so that copies of one
    row spread too; it is written, since a place may be another when it is computed again. Counts are a partial
    aggregate of SLOT_BLOCKS rows a shard. Put only narrow columns through this: they are written and its window is a
    shuffle.
    """
    from pyspark.sql import Window

    own = df.drop("_slot_block", "_slot_row", "_slot_first")
    block = F.pmod(F.xxhash64(F.lit("slot"), *keys, F.monotonically_increasing_id()), F.lit(SLOT_BLOCKS)).cast("int")
    df = materialise(own.withColumn("_slot_block", block), "slot-rows")
    counts = df.groupBy(shard, "_slot_block").agg(F.count("*").alias("_slot_n"))
    before = Window.partitionBy(shard).orderBy("_slot_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "_slot_block", F.coalesce(F.sum("_slot_n").over(before), F.lit(0)).alias("_slot_first"))
    inside = Window.partitionBy(shard, "_slot_block").orderBy(*keys)
    out = df.withColumn("_slot_row", F.row_number().over(inside)).join(counts, [shard, "_slot_block"])
    return out.withColumn(to, (F.col("_slot_first") + F.col("_slot_row") - 1).cast("long")).drop("_slot_block", "_slot_row", "_slot_first")
