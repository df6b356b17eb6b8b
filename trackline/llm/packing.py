"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens; a full piece is a sequence by itself. The other
pieces are dealt into blocks of like size. For each block a few islands breed packings: a gene is a bin.
Crossover injects whole well-filled bins of one parent into the other, drops the bins that now hold a
piece twice, and puts the displaced pieces back by best fit, longest first. Between epochs the islands
of a block pass their elite on to the next one. The best packing's nearly full bins are final; the pieces
of its open bins meet those of other blocks in another round, until one block is left.

Only lengths travel: a block is a row of bounded size, a task breeds some rows, and the driver learns
nothing but the number of pieces. The first parent is best-fit decreasing, so no packing is worse.

Defined results: a null text has no tokens but the separator; repeated rows are packed one by one; an
empty table gives an empty table; an overlong document is cut at multiples of the capacity; extra columns
are not carried.
"""

from __future__ import annotations

import gc
import math
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import materialise

CAPACITY = 2048
#: Pieces that one block holds on average.
BLOCK = 4096
ISLANDS, EPOCHS, POPULATION, CHILDREN = 2, 2, 4, 8
#: Bins this full are closed before the last round.
CLOSED = 0.995
#: Sequences' numbers begin with their round's, and those of full pieces with this one. As each round closes half of the
#: pieces, one block is left long before.
WHOLE = 127
#: Words that a worker remembers with their ids, twice: those used lately, and those before.
MEMORY = 200_000
#: Bytes of texts that are encoded at once, but for a longer text.
SLICE = 4_000_000
#: Marks that end words: they make a piece of their own behind letters, whichever they are.
MARKS = ".,;:!?\"#$%&()*+-/<=>@[\\]^_`{|}~"


def _stem(word: str) -> str:
    """The word without marks that end it, where the pre-tokenizer parts them: after nothing but letters, and only
    letters after the tokenizer's normalising. ASCII letters are lower-cased, as the tokenizer does. Else the word."""
    stem = word.rstrip(MARKS)
    if not stem.isalpha():
        return word
    if stem.isascii():
        return stem.lower()
    return stem if is_normalized("NFC", stem) and len(stem.lower()) == len(stem) else word


class WordIds:
    """Ids of a text as little-endian 32-bit numbers, by a public tokenizer that treats words apart.

    Its pre-tokenizer never joins characters across white space, so words are encoded once each.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Which ids end a piece; none, if the tokenizer doesn't mark them.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[k for w, k in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.stems_before: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str] | pa.Array, end: int = 0) -> list[bytes]:
        if not len(texts):
            return []
        # What is remembered has no cycles; looking for them again and again would take a fifth of the time.
        gc.disable()
        # Arrow numbers the different words, so that Python sees each of them once and numpy lays out their ids.
        rows = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "\n", " "), " ")
        numbered = rows.values.dictionary_encode()
        different = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.now) > MEMORY:
            self.now, self.before = {}, self.now
        if len(self.stems) > MEMORY:
            self.stems, self.stems_before = {}, self.stems
        now, before, stems = self.now, self.before, self.stems
        words = []
        for w in different:
            if w not in now:
                if w in before:
                    now[w] = before[w]
                else:
                    words.append(w)
        starts = list(map(_stem, words))
        ends = [w[len(s) :] for w, s in zip(words, starts, strict=True)]
        parts = {*starts, *ends}.difference(stems)
        stems.update((p, self.stems_before[p]) for p in parts if p in self.stems_before)
        parts.difference_update(self.stems_before)
        self._learn(parts)
        now.update((w, stems[s] + stems[e] if e else stems[s]) for w, s, e in zip(words, starts, ends, strict=True))
        known = [*map(now.__getitem__, different), int(end).to_bytes(4, "little")]
        gc.enable()
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")
        # The end is one more word behind each text.
        last = rows.offsets.to_numpy()[1:].astype(np.int64)
        word = np.insert(numbered.indices.to_numpy(), last, len(different))
        n = size[word]
        to = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[word] - (to - n), n)
        at += np.arange(len(at))
        out = ids[at].tobytes()
        cut = (to[last + np.arange(len(texts))] * 4).tolist()
        return [out[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def _learn(self, parts: set[str]) -> None:
        letters = [p for p in parts if p.isalpha()]
        rest = [p for p in parts if not p.isalpha()]
        # Words of letters are one piece each, so many are encoded in one call and cut where a piece ends.
        for i in range(0, len(letters), 1000):
            some = letters[i : i + 1000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            if len(cut) != len(some) or cut[-1] != 4 * len(ids):
                rest += some
                continue
            raw = ids.tobytes()
            self.stems.update((w, raw[a:b]) for w, a, b in zip(some, [0, *cut], cut, strict=False))
        for i in range(0, len(rest), 5000):
            some = rest[i : i + 5000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.stems[w] = array("I", e.ids).tobytes()


_loaded: dict[str, WordIds] = {}


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, null ones empty, in slices that end with the text that fills SLICE; memory follows these, not batches."""
    texts = pc.fill_null(texts, "")
    filled = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(filled, (filled[at - 1] if at else 0) + SLICE)) + 1
        yield texts[at:to]
        at = to
        # Arrow would keep what a slice took, in each worker.
        pa.default_memory_pool().release_unused()


def pieces_of(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """pid, doc_id, piece, start, length, ids_crc32: the pieces of each document, in a table."""

    @F.arrow_udf("n long, crcs array<long>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = WordIds(vocabulary)
        words = _loaded[vocabulary]
        for batch in batches:
            n, crcs = [], []
            for some in slices(batch):
                for ids in words.encode_batch(some, end):
                    n.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[k : k + 4 * capacity]) for k in range(0, len(ids), 4 * capacity)])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["n", "crcs"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), cut(F.col(text).cast("string")).alias("t"))
    rows = rows.select("doc_id", F.col("t.n").alias("n"), F.posexplode("t.crcs").alias("piece", "ids_crc32"))
    start = F.col("piece").cast("long") * capacity
    rows = rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("long").alias("length"), "ids_crc32")
    return materialise(rows.withColumn("pid", F.monotonically_increasing_id()), "packing-pieces")


class _Bins:
    """Bins under best fit: the open ones ordered by the room they have left."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity, self.bins = sizes, capacity, [list(b) for b in bins or []]
        self.room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(self.bins))

    def put(self, items: list[int]) -> None:
        sizes, room, bins = self.sizes, self.room, self.bins
        for i in items:
            at = bisect_left(room, (sizes[i], -1))
            if at == len(room):
                bins.append([i])
                left, k = self.capacity - sizes[i], len(bins) - 1
            else:
                left, k = room.pop(at)
                bins[k].append(i)
                left -= sizes[i]
            insort(room, (left, k))


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are filled unevenly: an open bin is worth more than many gaps."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def cross(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject well-filled bins of `other` into `one`, drop bins with duplicates, best-fit what they held."""
    full = [b for b in other if sum(sizes[i] for i in b) >= 0.98 * capacity] or other
    taken = [b for b, t in zip(full, rng.random(len(full)) < rng.uniform(0.1, 0.5), strict=True) if t]
    inside = {i for b in taken for i in b}
    keep, loose = [], []
    fills = sorted(sum(sizes[i] for i in b) for b in one)
    # Mutation: the least filled bins are dissolved as well.
    worst = fills[min(len(fills) - 1, int(rng.integers(1, 6)))] if fills else 0
    for b in one:
        if sum(sizes[i] for i in b) <= worst or not inside.isdisjoint(b):
            loose += [i for i in b if i not in inside]
        else:
            keep.append(b)
    child = _Bins(sizes, capacity, taken + keep)
    child.put(sorted(loose, key=lambda i: -sizes[i]))
    return child.bins


def evolve(sizes: list[int], capacity: int, start: list[list[list[int]]], seed: int) -> list[list[int]]:
    """One island's epoch: its fittest packing. `start` may hold elites; with none, parents are packed anew."""
    rng = np.random.default_rng(seed)
    length = np.asarray(sizes, float)

    def packed(noise: float) -> list[list[int]]:
        bins = _Bins(sizes, capacity)
        bins.put(np.argsort(-length * (1 + noise * rng.random(len(sizes))), kind="stable").tolist())
        return bins.bins

    people = [list(map(list, p)) for p in start] or [packed(0)]
    least = -(-sum(sizes) // capacity)
    if min(map(len, people)) == least:
        # No packing has fewer bins.
        return min(people, key=len)
    while len(people) < POPULATION:
        people.append(packed(0.1 * len(people)))
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(people)), reverse=True)
    n = len(scored)
    for _ in range(CHILDREN):
        if -scored[0][0][0] <= least:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child, n = cross(scored[min(i, j)][2], scored[max(i, j)][2], sizes, capacity, rng), n + 1
        scored = sorted([*scored, (fitness(child, sizes, capacity), n, child)], reverse=True)[:POPULATION]
    return scored[0][2]


def _packing(blocks: DataFrame, capacity: int) -> DataFrame:
    """pid, length, block, bin, offset, fill, from rows of block and items (structs of length, pid)."""
    kinds = "block long, island int, lengths array<int>, bins array<int>, score array<double>"

    def breed(batches: Iterator[pd.DataFrame], epoch: int) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                sizes = [int(x) for x in r.lengths]
                start = []
                for told in ([r.bins, r.guest] if epoch else []):
                    bins: dict[int, list[int]] = {}
                    for i, b in enumerate(told):
                        bins.setdefault(int(b), []).append(i)
                    start.append(list(bins.values()))
                best = evolve(sizes, capacity, start, int(r.block) * 1009 + int(r.island) * 31 + epoch)
                number = np.zeros(len(sizes), np.int32)
                for k, b in enumerate(best):
                    number[b] = k
                out.append((r.block, r.island, r.lengths, number, list(map(float, fitness(best, sizes, capacity)))))
            yield pd.DataFrame(out, columns=["block", "island", "lengths", "bins", "score"])

    islands = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.length").alias("lengths"))
    spark = blocks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = materialise(islands.repartition(parts, "block", "island").mapInPandas(lambda b: breed(b, 0), kinds), "packing-epoch")
    for epoch in range(1, EPOCHS):
        guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("bins").alias("guest"))
        met = state.join(guests, ["block", "island"]).select("block", "island", "lengths", "bins", "guest")
        state = materialise(met.mapInPandas(lambda b, e=epoch: breed(b, e), kinds), "packing-epoch")
    best = state.groupBy("block").agg(F.max_by("bins", F.struct("score", "island")).alias("bins"))
    rows = blocks.join(best, "block").select("block", F.inline(F.arrays_zip(F.col("items.pid").alias("pid"), F.col("items.length").alias("length"), F.col("bins").alias("bin"))))
    from pyspark.sql import Window

    # A bin holds few pieces, so this window is small for every key.
    inside = Window.partitionBy("block", "bin")
    before = inside.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).withColumn("fill", F.sum("length").over(inside))


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Add sequence_id and offset to the pieces (pid, length, ...)."""
    from pyspark.sql import Window

    whole = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(WHOLE << 56).bitwiseOR(F.col("pid")), "offset": F.lit(0).cast("long")})
    short = pieces.filter(F.col("length") < capacity)
    left = short.select("pid", F.col("length").cast("int").alias("length"))
    done = None
    for k in range(WHOLE):
        n = left.count()
        blocks = max(1, math.ceil(n / block))
        rows = left.groupBy(F.pmod(F.xxhash64(F.lit(k), "pid"), F.lit(blocks)).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("length", "pid")), asc=False).alias("items"))
        found = materialise(_packing(materialise(rows, "packing-blocks"), capacity), "packing-round")
        last = blocks == 1 or k == WHOLE - 1
        # Where few bins can be nearly full, those that are fuller than others are, so half of the pieces at least.
        middle = F.median("fill").over(Window.partitionBy("block"))
        found = found.withColumn("closed", F.lit(last) | (F.col("fill") >= F.least(F.lit(CLOSED * capacity), middle)))
        number = F.lit(k << 56).bitwiseOR(F.shiftleft("block", 24)).bitwiseOR(F.col("bin").cast("long"))
        closed = found.filter("closed").select("pid", number.alias("sequence_id"), "offset")
        done = closed if done is None else done.union(closed)
        if last:
            break
        left = materialise(found.filter("NOT closed").select("pid", "length"), "packing-left")
    return short.join(done, "pid").select(*whole.columns).union(whole)
