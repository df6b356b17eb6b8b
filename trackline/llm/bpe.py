"""Byte-level BPE by a segment tree over adjacent pair ranks.

A piece of text is a row of symbols. The tree's leaves hold the rank of each adjacent pair with its place,
inner nodes hold the least of their children, so the root is the leftmost pair of lowest rank. A merge
changes two pairs, and each change climbs to the root: a logarithmic update. Merging goes on until the
root says that no pair has a rank. Many pieces of like length go through their trees in step, as rows of
one array; a long piece has an array to itself.

Pieces repeat, so each worker remembers what it has encoded, within a bound; a forgotten piece is encoded
again. Spark deals out the texts; nothing is shuffled.

Defined results: a null text is empty, no ids, and decodes to an empty text; every row is encoded for
itself, so repeated rows get equal results; an empty table gives an empty table; other columns stay, but those
with the names of results are replaced; a very long text is cut where no piece reaches over, and its longest piece
alone bounds what a tree holds.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import free_name

#: Stretches of text that a worker remembers with their ids, twice: those used lately, and those before.
MEMORY = 250_000
#: Symbols in one array of trees.
CELLS = 1 << 18
#: Fewer pieces of a length than this go through their trees one by one.
FEW = 16
_NONE = np.int64(1) << np.int64(62)
#: A text may be cut before a single space or line break between two other characters: no piece reaches over it.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: White space that forbids to cut at every space.
_WIDE = re.compile(r"\s\s|\A\s|\s\Z")
#: Marks that are one piece where they end a word of letters.
_MARKS = ".,;:!?"


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _recall(keys: set[str], now: dict, before: dict) -> list[str]:
    """Bring back what was known before; the keys that are not known."""
    missing = [k for k in keys if k not in now]
    now.update((k, before[k]) for k in missing if k in before)
    return [k for k in missing if k not in before]


class ByteBpe:
    """A byte-level vocabulary file of the tokenizers library, with our own merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        symbol = _byte_symbols()
        back = {c: b for b, c in symbol.items()}
        self.byte_id = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        self.ranks = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.ranks]
        self.pair_rank = {int(p): int(r) for p, r in zip(self.pairs, self.ranks, strict=True)}
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: bytes(back[c] for c in s) for s, i in vocab.items() if i not in self.special.values()} | {i: s.encode() for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.decimal = [str(i).encode() for i in range(max(self.tokens) + 1)]
        # The ids of a piece or stretch: their number, the ids as decimals joined by commas, and the bytes they decode to.
        self.known: dict[str, tuple[int, bytes, bytes]] = {}
        self.chunks: dict[str, tuple[int, bytes, bytes]] = {}
        self.known_before, self.chunks_before = {}, {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge's rank of each pair of ids, or _NONE."""
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Encode pieces whose lengths share a power of two, by one segment tree a row."""
        rows, width = len(pieces), max(map(len, pieces))
        leaves = 1 << max(1, (width - 1).bit_length())
        ids = np.full((rows, leaves + 1), -1, np.int64)
        for r, p in enumerate(pieces):
            ids[r, : len(p)] = self.byte_id[np.frombuffer(p, np.uint8)]
        after = np.tile(np.arange(1, leaves + 2), (rows, 1))
        before = np.tile(np.arange(-1, leaves), (rows, 1))
        place = np.arange(leaves, dtype=np.int64)
        bits = np.int64(leaves.bit_length())
        tree = np.full((rows, 2 * leaves), _NONE, np.int64)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        tree[:, leaves:] = np.where(rank == _NONE, _NONE, (rank << bits) | place)
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            root = tree[live, 1]
            new = self.made[root >> bits]
            i = root - ((root >> bits) << bits)
            j = after[live, i]
            k = after[live, j]
            ids[live, i], ids[live, j], after[live, i] = new, -1, k
            inside = k <= leaves
            before[live[inside], k[inside]] = i[inside]
            right = np.where(inside, ids[live, np.minimum(k, leaves)], -1)
            h = before[live, i]
            left = np.where(h >= 0, ids[live, np.maximum(h, 0)], -1)
            # The merged pair, the pair that its right symbol began, and the pair that ends in it.
            own, prior = self._rank(new, right), self._rank(left, new)
            self._set(tree, live, i, np.where(own == _NONE, _NONE, (own << bits) | i), leaves)
            self._set(tree, live, j, np.full(len(j), _NONE), leaves)
            some = h >= 0
            self._set(tree, live[some], h[some], np.where(prior[some] == _NONE, _NONE, (prior[some] << bits) | h[some]), leaves)
            live = live[tree[live, 1] < _NONE]
        return [tuple(row[row >= 0].tolist()) for row in ids]

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """The same tree for one piece, in plain Python: faster where few pieces share a length."""
        ids, n = self.byte_id[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        leaves = 1 << max(1, (n - 1).bit_length())
        none, pairs = (1 << 30) << 32, self.pair_rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = pairs.get((ids[i] << 32) | ids[i + 1], (1 << 30)) << 32 | i
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (root := tree[1]) < none:
            i, new = root & 0xFFFFFFFF, int(self.made[root >> 32])
            j = after[i]
            k, h = after[j], before[i]
            ids[i], ids[j], after[i] = new, -1, k
            changes = [(j, none), (i, none)]
            if k < n:
                before[k] = i
                changes[1] = (i, pairs.get((new << 32) | ids[k], (1 << 30)) << 32 | i)
            if h >= 0:
                changes.append((h, pairs.get((ids[h] << 32) | new, (1 << 30)) << 32 | h))
            for leaf, value in changes:
                node = leaf + leaves
                tree[node] = value
                while node > 1:
                    node >>= 1
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return tuple(i for i in ids if i >= 0)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, leaves: int) -> None:
        """Set one leaf in each row and renew the nodes above it."""
        node = leaf + leaves
        tree[rows, node] = value
        while leaves > 1:
            node, leaves = node >> 1, leaves >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _told(self, ids: Iterable[int]) -> tuple[int, bytes, bytes]:
        decimal, tokens = self.decimal, self.tokens
        return len(ids), b",".join([decimal[i] for i in ids]), b"".join([tokens[i] for i in ids])

    def _learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that are not known yet, in groups of like length."""
        by: dict[int, list[str]] = {}
        for p in pieces:
            by.setdefault((len(p.encode()) - 1).bit_length(), []).append(p)
        for size, group in sorted(by.items()):
            step = max(1, CELLS >> size)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                raw = [p.encode() for p in part]
                found = [self.merge_one(p) for p in raw] if len(part) < FEW else self.merge(raw)
                self.known.update(zip(part, map(self._told, found), strict=True))

    def _cut(self, text: str) -> list[str]:
        """The stretches of a text that are encoded by themselves."""
        out = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(part)
            elif part and _WIDE.search(part):
                out += _CUT.split(part)
            elif part:
                # The same cuts, faster: each word but the first keeps the space or line break before it.
                words = part.replace("\n", " \n").split(" ")
                out.append(words[0])
                out += [w if w[0] == "\n" else " " + w for w in words[1:]]
        return out

    def _pieces(self, stretch: str) -> list[str]:
        word = stretch[1:] if stretch[0] == " " else stretch
        stem = word.rstrip(_MARKS)
        if stem.isalpha():
            # Letters, and marks after them, are what the pattern finds.
            return [stretch] if len(stem) == len(word) else [stretch[: len(stem) - len(word)], word[len(stem) :]]
        return self.pieces(stretch)

    def stretches(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        """Each text as stretches: number of ids, the ids as decimals joined by commas, and what they decode to."""
        # What is remembered has no cycles; looking for them again and again would take a fifth of the time.
        gc.disable()
        try:
            return self._stretches(texts)
        finally:
            gc.enable()

    def _stretches(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        cut = [self._cut(t) for t in texts]
        if len(self.chunks) > MEMORY or len(self.known) > MEMORY:
            self.known_before, self.chunks_before, self.known, self.chunks = self.known, self.chunks, {}, {}
        new = _recall(set().union(*cut), self.chunks, self.chunks_before)
        split = {c: self._pieces(c) for c in new if c not in self.special}
        self._learn(_recall(set(chain.from_iterable(split.values())), self.known, self.known_before))
        known = self.known
        self.chunks.update((c, self._told((self.special[c],))) for c in new if c in self.special)
        for c, ps in split.items():
            if len(ps) == 1:
                self.chunks[c] = known[ps[0]]
            else:
                counts, ids, decoded = zip(*map(known.__getitem__, ps), strict=True)
                self.chunks[c] = sum(counts), b",".join(ids), b"".join(decoded)
        get = self.chunks.__getitem__
        return [list(map(get, row)) for row in cut]

    def encode_batch(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each text the number of its ids, the ids as decimals joined by commas, and the bytes they decode to."""
        out = []
        for found in self.stretches(texts):
            counts, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            out.append((sum(counts), b",".join(ids), b"".join(decoded)))
        return out

    def encode(self, text: str) -> list[int]:
        return _ids(self.encode_batch([text])[0][1])

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def _ids(joined: bytes) -> list[int]:
    return list(map(int, joined.split(b","))) if joined else []


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The vocabulary, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _small(series: Iterable[str | None], limit: int = 2_000_000) -> Iterator[list[str]]:
    have, size = [], 0
    for t in series:
        have.append(t or "")
        size += len(have[-1])
        if size >= limit:
            yield have
            have, size = [], 0
    if have:
        yield have


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Add n_tokens, and as asked `ids` (array) and `decoded`, or the SHA-256 of the joined ids and of the
    decoded text. `vocabulary` is a path that every executor can open. Only the text goes to Python."""
    added = {"n_tokens": "long"} | ({"ids": "array<int>", "decoded": "string"} if ids else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})

    @F.pandas_udf(", ".join(f"{c} {k}" for c, k in added.items()))
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(vocabulary)
        for batch in batches:
            rows = []
            for texts in _small(batch):
                for n, joined, raw in bpe.encode_batch(texts):
                    decoded = raw.decode("utf-8", "replace")
                    rows.append([n, *([_ids(joined), decoded] if ids else []), *([hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] if digests else [])])
            yield pd.DataFrame(rows, columns=list(added))

    made = free_name(docs, "_encoded")
    # The text may itself have a name that is replaced.
    out = docs.withColumn(made, work(F.col(text).cast("string")))
    return out.select(*[c for c in docs.columns if c not in added], f"{made}.*")
