"""Token counts without ids: pieces once per distinct pre-token, joined to the frequencies of each document.

A pass over the texts gathers the distinct pre-tokens. The tokenizers library counts the pieces of each,
once. A second pass finds the pre-token frequencies of each document, which meet the counts in a join and
are summed; ids are never made.

Pre-tokens that many documents share are a short list: those seen in at least so many documents that at
most KNOWN of them remain, none longer than SHORT. Their counts, a table of bounded size, go to every task,
which sums them on the spot; so no hot pre-token is ever shuffled. All other pre-tokens, of which there may
be any number, are joined by key. Where the line between both falls changes no result.

Defined results: a null or empty text has no tokens and no bytes; each row is counted for itself, so
repeated rows get equal counts; an empty table gives an empty table; kept columns may have any names; of a
very long text only one copy and its frequencies are held at a time, and a long pre-token is joined by a
128-bit hash.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import materialise

#: Pre-tokens whose counts every task holds, at most, and the characters of the longest.
KNOWN, SHORT = 200_000, 64
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHER = 200_000
#: Steps in which a doubling of the number of documents is told apart.
STEPS = 8


class PreTokens:
    """A byte-level vocabulary file: its pre-tokens, and the number of pieces of one."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        way = told["pre_tokenizer"] or {}
        if told["normalizer"] or way.get("type") != "ByteLevel" or way.get("add_prefix_space") or not way.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level vocabulary without normalising")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what surrounds them")
        special = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        # The fixed pattern of byte-level vocabularies.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        model = Tokenizer.from_file(path).model
        plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
        # Bytes that are no printable characters are written as the characters from 256 on.
        shifted = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.count: Callable[[str], int] = lambda p: len(model.tokenize(p.encode().decode("latin-1").translate(shifted)))

    def of(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens it holds."""
        if self.special is None or not self.special.search(text):
            return self.pieces(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pieces(part)], len(parts) - 1


_loaded: dict[str, PreTokens] = {}


def pre_tokens(path: str) -> PreTokens:
    """The vocabulary, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


def key_of(piece: str) -> bytes:
    """What a pre-token is joined by: itself, or 128 bits of a long one."""
    raw = piece.encode()
    return b"\0" + raw if len(raw) <= SHORT else b"\1" + hashlib.md5(raw, usedforsecurity=False).digest()


def distinct_counts(texts: DataFrame, vocabulary: str) -> DataFrame:
    """piece, seen, n: each distinct pre-token of texts(text), the documents it is in, and its number of pieces."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, seen = pre_tokens(vocabulary).of, Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(set(split(text)[0]))
                if len(seen) > GATHER:
                    yield pd.DataFrame({"piece": list(seen), "seen": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"piece": list(seen), "seen": list(seen.values())})

    @F.pandas_udf("key binary, n int")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = pre_tokens(vocabulary).count
        for pieces in batches:
            yield pd.DataFrame({"key": list(map(key_of, pieces)), "n": list(map(count, pieces))})

    pieces = texts.mapInPandas(gather, "piece string, seen long").groupBy("piece").agg(F.sum("seen").alias("seen"))
    # A long pre-token is not needed any more once its key is known.
    told = F.when(F.octet_length("piece") <= SHORT, F.col("piece")).alias("piece")
    return pieces.withColumn("asked", ask("piece")).select(told, "seen", "asked.key", "asked.n")


def shared_by_many(counts: DataFrame, known: int) -> dict[str, int]:
    """The short pre-tokens in most documents with their pieces, at most `known`."""
    step = F.floor(F.log2("seen") * STEPS)
    short = counts.filter("piece IS NOT NULL")
    # A long has 63 binary digits, so the histogram has at most 63 * STEPS + 1 rows.
    held, least = 0, math.inf
    for row in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += row["count"]
        if held > known:
            break
        least = row["step"]
    if least == math.inf:
        return {}
    return {r.piece: r.n for r in short.filter(step >= F.lit(least)).select("piece", "n").toLocalIterator()}


def count_tokens(docs: DataFrame, vocabulary: str, keep: list[Column | str], text: str = "text", known: int = KNOWN) -> DataFrame:
    """The columns `keep` of each document, and n_bytes (UTF-8) and n_tokens of its text."""
    told = F.coalesce(F.col(text).cast("string"), F.lit(""))
    counts = materialise(distinct_counts(docs.select(told.alias("text")), vocabulary), "pretoken-counts")
    shared = docs.sparkSession.sparkContext.broadcast(shared_by_many(counts, known))

    @F.pandas_udf("n long, keys array<binary>, freqs array<int>")
    def frequencies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        split, pieces = pre_tokens(vocabulary).of, shared.value
        for batch in batches:
            rows = []
            for t in batch:
                found, special = split(t)
                n, keys, freqs = special, [], []
                for p, f in Counter(found).items():
                    if (c := pieces.get(p)) is None:
                        keys.append(key_of(p))
                        freqs.append(f)
                    else:
                        n += c * f
                rows.append((n, keys, freqs))
            yield pd.DataFrame(rows, columns=["n", "keys", "freqs"])

    kept = F.struct(*keep, F.octet_length(told).cast("long").alias("n_bytes"))
    each = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), frequencies(told).alias("f"))
    # A document's own row meets no count: its key is its row, behind a byte that no other key begins with.
    own = F.struct(F.concat(F.lit(bytearray(b"\2")), F.encode(F.col("row").cast("string"), "UTF-8")).alias("key"), F.lit(0).alias("freq"), F.col("f.n").alias("n"), F.col("kept"))
    rest = F.zip_with("f.keys", "f.freqs", lambda k, f: F.struct(k.alias("key"), f.alias("freq"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(each.schema["kept"].dataType).alias("kept")))
    rows = each.select("row", F.explode(F.concat(F.array(own), rest)).alias("x")).select("row", "x.*")
    met = rows.join(counts.select("key", F.col("n").alias("pieces")), "key", "left")
    total = F.sum(F.col("n") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("n_tokens")
    return met.groupBy("row").agg(F.any_value("kept", F.lit(True)).alias("kept"), total).select("kept.*", F.col("n_tokens").cast("long").alias("n_tokens"))
