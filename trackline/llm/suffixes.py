"""Repeated windows by a depth-limited radix sort of suffixes.

All suffixes would be sorted only as deep as the threshold: two that agree so far are a repeated window,
and nothing else is asked. Most-significant-digit passes find these groups without ordering a suffix past
the digit that tells it from all others; a suffix alone in its group is dropped at that pass.

1. The first digit is the window's least gram (by hash), read at its place in the window. Neighbouring
   suffixes share it, so a run of suffixes is one row. Equal windows have equal least grams at equal places.
   Runs with a gram of their own are done.
2. The second digit is all that the run spans. Runs that are equal throughout are repeated throughout, and
   one stands for all: copies and shared passages end here, whatever their number.
3. Only runs that share a gram but not their content go deeper. They are cut into stretches of 32, then 4,
   then single suffixes. A stretch whose common core no other run has is dropped; stretches that agree in
   all they span are repeated throughout and are represented by one; the rest is cut again. Groups of two
   or more single suffixes are exactly the repeated windows left.

The texts are written once, bucketed by row, so that each pass meets them without another shuffle.

Digits after the first are 64-bit hashes, compared only within one gram and place, that is within another
64 bits. Each pass is an aggregation with partial sums, so one passage in a third of all rows is no burden.

Units are the bytes of the text, or its words. Spans are removed in bytes; for words, from the first word's
first byte to the byte before the next word. Windows never cross documents.

Defined results: null and empty texts, and texts shorter than a window, keep all they have; repeated rows
are copies of one another; a null id is returned as it is; an empty table gives an empty table; extra
columns are not carried. A text is handled whole: memory in a task follows the longest text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import discard, materialise, shared_folder
from trackline.llm.neardup import _MIX, _mix, _words

#: Symbols that one block of arrays holds, but for a longer text.
BLOCK = 1 << 19
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(11).integers(1, (1 << 64) - 1, 256, dtype=np.uint64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _powers(base: int, n: int) -> np.ndarray:
    have = _powers.cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * BLOCK), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 8 * BLOCK:
            _powers.cache[base] = have
    return have[:n]


_powers.cache = {}


def symbols(text: bytes, unit: str) -> np.ndarray:
    if unit == "bytes":
        return _BYTES[np.frombuffer(text, np.uint8)]
    words = text.split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


class _Block:
    """Hashes of any stretch of some texts' symbols, laid end to end."""

    def __init__(self, parts: list[np.ndarray]):
        self.ends = np.cumsum([len(p) for p in parts])
        s = np.concatenate(parts)
        self.size = len(s)
        self.sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(s * _powers(_BASE, len(s)), out=self.sums[1:])

    def hashes(self, starts: np.ndarray | slice, stops: np.ndarray | slice) -> np.ndarray:
        back = _powers(_INVERSE, self.size + 1)
        return _mix((self.sums[stops] - self.sums[starts]) * back[starts])


def runs_of(parts: list[np.ndarray], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first, n, e0, g, c) of every run in texts of at least `length` symbols.

    first is the run's first window start in its text, e0 the place of the gram after it.
    """
    b = _Block(parts)
    width = length - gram + 1
    grams = b.hashes(slice(0, b.size - gram + 1), slice(gram, b.size + 1))
    v = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
    full = np.full(-(-len(v) // width) * width, ~np.uint64(0))
    full[: len(v)] = v
    full = full.reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(v) - width + 1
    least = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[:m]
    good = np.arange(m) + length <= b.ends[text]
    starts = np.flatnonzero(good)
    # Positions keep 24 bits only; add the rest from the window's start.
    high = starts & ~int(_LOW)
    at = least[starts] | high
    at += np.where(at < starts, int(_LOW) + 1, 0)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(starts) != 1))))
    first = starts[new]
    n = np.diff(np.append(new, len(starts)))
    anchor = at[new]
    begin = (b.ends - [len(p) for p in parts])[text[first]]
    return text[first], first - begin, n, anchor - first, grams[anchor], b.hashes(first, first + n - 1 + length)


def _blocks(texts: Iterator[np.ndarray], length: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    which, parts, size = [], [], 0
    for k, s in enumerate(texts):
        if len(s) >= length:
            which.append(k)
            parts.append(s)
            size += len(s)
            if size >= BLOCK:
                yield which, parts
                which, parts, size = [], [], 0
    if parts:
        yield which, parts


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8")


def bucketed(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows with a row key `rid`, in a table in the shared folder that is bucketed by it."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(doc_id), F.md5(raw)).alias("rid"), F.col(doc_id).alias("doc_id"), raw.alias("text"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    rows.repartition(parts, "rid").write.bucketBy(parts, "rid").sortBy("rid").option("path", shared_folder(spark, "suffix-texts")).saveAsTable(name)
    return spark.table(name)


def _levels(length: int) -> list[int]:
    return [z for z in (32, 4) if z <= length // 8] + [1]


def repeated_starts(texts: DataFrame, length: int, unit: str, gram: int | None = None) -> DataFrame:
    """rid, spans: for each text that holds repeated windows, their starts, as start * 4096 + how many
    adjacent ones. `texts` has rid and text."""
    if not 1 < length < 4096:
        raise ValueError("a window has 2 to 4095 symbols")
    gram = gram or max(1, min(32, length // 6))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rids = batch["rid"].to_numpy()
            for which, parts in _blocks((symbols(_encoded(t), unit) for t in batch["text"]), length):
                t, first, n, e0, g, c = runs_of(parts, length, gram)
                cut = np.searchsorted(t, np.arange(len(parts) + 1))
                arrays = {"g": g.view(np.int64), "c": c.view(np.int64), "a": (first + e0).astype(np.int32), "lo": (e0 - n + 1).astype(np.int16), "hi": e0.astype(np.int16)}
                yield pd.DataFrame({"rid": rids[which]} | {k: [a[i:j] for i, j in zip(cut, cut[1:], strict=False)] for k, a in arrays.items()})

    kinds = "rid long, g array<long>, c array<long>, a array<int>, lo array<smallint>, hi array<smallint>"
    found = materialise(texts.filter(F.octet_length("text") >= length).select("rid", "text").mapInPandas(find, kinds), "suffix-runs")

    # Pass 1: runs whose gram occurs again. `cid` names a run's content, lo and hi the places of its gram.
    # In a table of its own, so that a hot gram's side of the join can be split.
    again = materialise(found.select(F.explode("g").alias("g")).groupBy("g").count().filter("count > 1").select("g"), "suffix-again")
    runs = found.select("rid", F.inline(F.arrays_zip("g", "c", "a", "lo", "hi"))).select("rid", "g", F.xxhash64("g", "c", "lo", "hi").alias("cid"), "a", "lo", "hi")
    runs = materialise(runs.join(again, "g"), "suffix-pass1")
    discard(found, again)

    # Pass 2: contents, and the grams that more than one content has.
    contents = materialise(runs.groupBy("g", "cid").agg(F.count("*").alias("times"), F.min(F.struct("rid", "a", "lo", "hi")).alias("at")).select("g", "cid", "times", "at.*"), "suffix-pass2")
    mixed = materialise(contents.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "suffix-mixed")
    resolved = contents.filter("times > 1").select("cid", "lo", "hi")
    asked = contents.join(mixed, "g").select("rid", "g", "cid", "a", "lo", "hi")

    for z in _levels(length):

        def digits(batches: Iterator[pd.DataFrame], z: int = z) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for text, runs_ in zip(batch["text"], batch["r"], strict=True):
                    b = _Block([symbols(_encoded(text), unit)])
                    rows = [(r["g"], r["cid"], r["a"], r["lo"], r["hi"]) for r in runs_]
                    for i in range(0, len(rows), 2048):
                        g, cid, a, lo, hi = (np.array(x, np.int64) for x in zip(*rows[i : i + 2048], strict=True))
                        n = hi // z - lo // z + 1
                        r = np.repeat(np.arange(len(n)), n)
                        k = lo[r] // z + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                        low, high = k * z, k * z + z - 1
                        core = b.hashes(a[r] - low, a[r] + length - high)
                        begin, end = a[r] - high, a[r] + length - low
                        inside = (begin >= 0) & (end <= b.size)
                        # What ends with its text is like nothing else here.
                        own = _mix(cid[r].view(np.uint64) + k.view(np.uint64) * _MIX[0])
                        full = np.where(inside, b.hashes(np.maximum(begin, 0), np.minimum(end, b.size)), own)
                        yield pd.DataFrame({"g": g[r], "cid": cid[r], "k": k.astype(np.int16), "core": core.view(np.int64), "full": full.view(np.int64)})

        # collect_list gathers the runs of one text, which its length bounds.
        by_text = asked.groupBy("rid").agg(F.collect_list(F.struct("g", "cid", "a", "lo", "hi")).alias("r"))
        met = texts.select("rid", "text").join(by_text, "rid").select("text", "r")
        cut = materialise(met.mapInPandas(digits, "g long, cid long, k smallint, core long, full long").distinct(), f"suffix-cut{z}")
        classes = materialise(cut.groupBy("g", "k", "core", "full").agg(F.count("*").alias("times"), F.min("cid").alias("cid")), f"suffix-classes{z}")
        same = cut.join(classes.filter("times > 1").select("g", "k", "core", "full"), ["g", "k", "core", "full"]).select("cid", "k")
        part = [F.greatest(F.col("lo"), F.col("k") * z).cast("smallint").alias("lo"), F.least(F.col("hi"), F.col("k") * z + z - 1).cast("smallint").alias("hi")]
        bounds = asked.select("cid", "lo", "hi").withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / z), F.floor(F.col("hi") / z)).cast("array<smallint>"))) if z > 1 else asked.select("cid", "lo", "hi").withColumn("k", F.explode(F.sequence("lo", "hi")))
        resolved = resolved.union(same.join(bounds, ["cid", "k"]).select("cid", *part))
        if z > 1:
            split = classes.groupBy("g", "k", "core").agg(F.min("full").alias("p"), F.max("full").alias("q")).filter("p <> q").select("g", "k", "core")
            wanted = classes.join(split, ["g", "k", "core"]).select("cid", "k")
            pieces = asked.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / z), F.floor(F.col("hi") / z)).cast("array<smallint>")))
            asked = materialise(pieces.join(wanted, ["cid", "k"]).select("rid", "g", "cid", "a", *part), f"suffix-asked{z}")

    resolved = materialise(resolved, "suffix-resolved")
    spans = runs.join(resolved.withColumnsRenamed({"lo": "from", "hi": "to"}), "cid")
    spans = spans.select("rid", ((F.col("a") - F.col("to")).cast("long") * 4096 + (F.col("to") - F.col("from") + 1)).alias("s"))
    return spans.groupBy("rid").agg(F.collect_set("s").alias("spans"))


def covered(spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal stretches that windows at the starts cover."""
    begin = np.sort(spans)
    end = (begin // 4096) + (begin % 4096) - 1 + length
    begin = begin // 4096
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > reach[:-1])))
    return begin[new], reach[np.append(new[1:] - 1, len(reach) - 1)]


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, unit: str = "bytes", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary, what is left of the text's UTF-8 bytes), one row a
    document, and the columns of `keep`. Every byte of a window that also starts anywhere else goes."""
    texts = bucketed(docs, doc_id, text, keep)
    spans = repeated_starts(texts, length, unit)

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(raw: pd.Series, spans: pd.Series) -> pd.DataFrame:
        found = []
        for t, s in zip(raw, spans, strict=True):
            raw_ = t.encode("utf-8")
            begin, end = covered(np.asarray(s, np.int64), length)
            if unit == "words":
                at = np.array([m.start() for m in _WORD.finditer(raw_)] + [len(raw_)])
                begin, end = at[begin], at[end]
            edge = np.concatenate(([0], end)), np.concatenate((begin, [len(raw_)]))
            found.append((int((end - begin).sum()), len(begin), b"".join(raw_[i:j] for i, j in zip(*edge, strict=True))))
        return pd.DataFrame(found, columns=["n_removed", "n_spans", "kept"])

    rows = texts.join(spans, "rid", "left")
    sized = ["doc_id", F.octet_length("text").cast("long").alias("n_bytes")]
    rest = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    none = F.lit(0).cast("long")
    # Texts without a span never leave the JVM.
    whole = rows.filter("spans IS NULL").select(*sized, none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"), *rest)
    changed = rows.filter("spans IS NOT NULL").withColumn("_cut", cut("text", "spans")).select(*sized, "_cut.*", *rest)
    return whole.union(changed)
