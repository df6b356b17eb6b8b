"""Near duplicates by MinHash, with odd sketches.

A text is the set of its word shingles, hashed to 64 bits. MinHash samples are cut into bands; texts that
agree on a band are candidates. The samples are also folded into a parity bitmap, the odd sketch: every
sample flips one bit, so samples that two texts share cancel in the XOR of their sketches, and its
population count tells the number of samples that differ, most precisely where few do. Candidates whose
sketches differ by far too much go; the others are confirmed on their full shingle sets.

The band length is chosen so that a pair at the threshold is missed by all bands with a chance under one
in a million. Texts with equal sets are one item throughout, so exact copies cost nothing further.

Defined results: a null or blank text has an empty set, is linked with nothing and stands alone; repeated
rows are linked like any other copies; a null id takes part in its group but never names it, and a group
of null ids only has a null component and keeps all; an empty table gives an empty table; extra columns
are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import discard, linked_groups, materialise

#: MinHash samples of a text, at most.
SAMPLES = 252
#: Bits of an odd sketch, in 64-bit words.
WORDS = 8
#: Words whose hash a Python worker remembers before it starts again.
MEMORY = 200_000

_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _odd(seed: int, n: int, bits: int = 64) -> np.ndarray:
    """n odd multipliers, the same in every process."""
    r = np.random.default_rng(seed)
    kind = np.uint64 if bits == 64 else np.uint32
    return r.integers(0, (1 << bits) - 1, n, dtype=kind, endpoint=True) | kind(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_words = _Words()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of the text's shingles. ASCII letters are lower-cased; with
    fewer words than a shingle has, the whole sequence is one shingle."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    by = _odd(1000 + width, width)
    total = h[: len(h) - width + 1] * by[0]
    for k in range(1, width):
        total += h[k : len(h) - width + 1 + k] * by[k]
    return np.unique(_mix(total))


def bands_for(threshold: int) -> tuple[int, int]:
    """Rows of a band and the number of bands, for a similarity in percent."""
    fits = [r for r in range(1, 17) if (1 - (threshold / 100) ** r) ** (SAMPLES // r) < 1e-6]
    rows = max(fits, default=1)
    return rows, SAMPLES // rows


_A, _B = _odd(1, SAMPLES, 32), _odd(2, SAMPLES, 32)
_FLIP = _odd(3, SAMPLES)


def minhash(values: np.ndarray) -> np.ndarray:
    """SAMPLES minima of 32-bit linear hashes of a set, in blocks that fit a core's cache."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 256):
        hashed = np.multiply.outer(x[i : i + 256], _A)
        hashed += _B
        np.minimum(low, hashed.min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of rows of samples: (n, SAMPLES) to (n, WORDS) of int64."""
    at = _mix((samples.astype(np.uint64) + np.uint64(1)) * _FLIP) >> np.uint64(64 - 9)
    bits = np.zeros((len(samples), WORDS * 64), np.uint8)
    rows = np.repeat(np.arange(len(samples)), SAMPLES)
    np.bitwise_xor.at(bits, (rows, at.ravel().astype(np.int64)), 1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _item(values: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, item, bands, sketch; item and the rest are null for empty sets."""
    rows, bands = bands_for(threshold)
    by, salt = _odd(4, rows), _mix(np.arange(bands, dtype=np.uint64) + np.uint64(7))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, items, low = [], [], np.zeros((len(batch), SAMPLES), np.uint32)
            for k, t in enumerate(batch["text"]):
                values = shingle_set(t, shingle)
                sizes.append(len(values))
                items.append(_item(values) if len(values) else None)
                if len(values):
                    low[k] = minhash(values)
            cut = low[:, : rows * bands].reshape(-1, bands, rows).astype(np.uint64)
            buckets = _mix((cut * by).sum(axis=2, dtype=np.uint64) + salt).view(np.int64)
            sketch = odd_sketch(low)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "item": items, "bands": [b if n else None for b, n in zip(buckets, sizes, strict=True)], "sketch": [b if n else None for b, n in zip(sketch, sizes, strict=True)]})

    rows_in = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = "doc_id string, n_shingles long, item binary, bands array<long>, sketch array<long>"
    return rows_in.mapInPandas(sign, kinds).withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def sketch_limit(threshold: int) -> int:
    """Population count of an XOR that texts at the threshold exceed in under one of 10**6 cases.

    For d differing samples z/2 (1 - exp(-4 d / z)) bits are expected, with a variance of about
    z/4 (1 - exp(-8 d / z)); d itself is binomial. The limit is five standard deviations above the mean.
    """
    j, z = threshold / 100, WORDS * 64
    d, spread = SAMPLES * (1 - j), (SAMPLES * j * (1 - j)) ** 0.5
    slope = 2 * np.exp(-4 * d / z)
    deviation = ((slope * spread) ** 2 + z / 4 * (1 - np.exp(-8 * d / z))) ** 0.5
    return int(z / 2 * (1 - np.exp(-4 * d / z)) + 5 * deviation)


def _full_sets(docs: DataFrame, doc_id: str, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """item, full (the set) of the wanted items (item, of, stands), from the documents that stand for them."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["text"]]
            yield pd.DataFrame({"item": batch["item"], "same": [_item(s) == o for s, o in zip(sets, batch["of"], strict=True)], "values": [s.view(np.int64) for s in sets]})

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("stands"))).select("text", "item", "of")
    found = rows.mapInPandas(collect, "item long, same boolean, values array<long>").filter("same")
    return found.select("item", F.col("values").alias("full")).dropDuplicates(["item"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Documents with 100 |A & B| >= threshold |A | B| are linked; a component is named by its smallest id,
    whose document is kept.
    """
    signed = materialise(signatures(docs, doc_id, text, shingle, threshold).withColumn("row", F.monotonically_increasing_id()), "neardup-signatures")
    # One row stands for all of equal sets, and its number for the set.
    stands = materialise(signed.filter("item IS NOT NULL").groupBy(F.col("item").alias("of")).agg(F.min("row").alias("unit")), "neardup-stands")
    sig = F.struct(F.col("n_shingles").alias("n"), *[F.col("sketch")[k].alias(f"s{k}") for k in range(WORDS)])
    one = signed.join(stands, F.col("row") == F.col("unit")).select(F.col("unit").alias("item"), F.col("item").alias("of"), "doc_id", sig.alias("sig"), F.col("bands").alias("buckets"))
    one = materialise(one, "neardup-items")
    limit = sketch_limit(threshold)

    def near(x: str, y: str) -> Column:
        x, y = F.expr(x), F.expr(y)
        differ = reduce(add, [F.bit_count(x[f"s{k}"].bitwiseXOR(y[f"s{k}"])) for k in range(WORDS)])
        return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * threshold) & (differ <= limit)

    def contents(items: DataFrame) -> DataFrame:
        return _full_sets(docs, doc_id, text, shingle, one.join(items, "item").select("item", "of", F.col("doc_id").alias("stands")))

    def alike(x: str, y: str) -> Column:
        # 100 |A & B| >= t |A | B|, with |A | B| = |A| + |B| - |A & B|.
        return F.size(F.array_intersect(x, y)) * (100 + threshold) >= (F.size(x) + F.size(y)) * threshold

    parts = linked_groups(one.select("item", "sig", "buckets"), near, contents, alike, "neardup")
    discard(one)
    groups = stands.join(parts, F.col("unit") == F.col("node"), "left").select("of", F.coalesce("component", "unit").alias("part"))
    groups = materialise(groups, "neardup-groups")
    named = materialise(signed.select("doc_id", "n_shingles", "item").join(groups, F.col("item") == F.col("of"), "left").select("doc_id", "n_shingles", "part"), "neardup-parts")
    discard(signed, stands, parts, groups)
    # In a table of its own, so that a large component's side of the join can be split.
    names = materialise(named.filter("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("first")), "neardup-names")
    out = named.join(names, "part", "left").select("doc_id", "n_shingles", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
