"""Merkle manifests, token counts and whitening against brute force on small fixtures."""

import hashlib
import random
import zlib
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackline.llm import merkle, tokencount, whitening
from trackline.llm.queries import op11_merkle_manifest, op12_pretoken_counts, op13_refined_whitening, public_vocabulary

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute_manifest(rows):
    """What each row (doc_id, source, lang, n_chars, text) leads to, hashing every message whole."""
    leaf = lambda r, text: digest(*map(told, (*r[:4], text)))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[k] = levels_of([leaf(r, r[4]) for r in groups[k]])
    top = levels_of([trees[k][-1][0] for k in names])
    root, out = top[-1][0], []
    for number, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now, siblings = leaf(r, text), []
            for tree, at in ((trees[k], i), (top, number)):
                for level in tree[:-1]:
                    first, slot = at // 16 * 16, at % 16
                    run = level[first : first + 16]
                    siblings += run[:slot] + run[slot + 1 :]
                    now = digest(*run[:slot], now, *run[slot + 1 :])
                    at //= 16
            out.append((r[0], trees[k][0][i], trees[k][-1][0], root, digest(*siblings), now, now == root))
    return sorted(out, key=str)


def random_rows(n, sources, seed):
    r = random.Random(seed)
    texts = [None, "", "Same Text", "ÄÖ ABC xyz é", "A" * 50_000]
    return [(r.choice([None, *range(n)]), r.choice(sources), r.choice([None, "en", "dé"]), r.choice([None, 7]), r.choice([*texts, f"Text {i}"])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    random_rows(700, [None, "", "a", "b", "é", "Z"], 1),
    random_rows(40, [f"s{i}" for i in range(30)], 2),
    [(5, "only", "en", 1, "Only One")],
    # One row repeated, so that a single key fills several ranges and levels.
    [(5, "hot", "en", 1, "Again And Again")] * 600 + [(6, None, None, None, None)],
    [(i, "one", "en", 1, f"T {i}") for i in range(257)],
], ids=["mixed", "many sources", "single", "repeated", "one source"])
def test_manifest_equals_hashing_everything(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    # Extra columns with the names of the operator's own.
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(["grp", "idx", "n", "digest", "place", "kids", "leaf", "root"])})
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs, COLUMNS).collect() == []


def test_manifest_takes_other_keys_and_changes(spark):
    """Dates as keys, and a change of another column: only the changed rows fail."""
    docs = spark.createDataFrame([(date(2020, 1, i), "a", i) for i in range(1, 31)], "day date, part string, value int")
    got = merkle.manifest(docs, ["day", "value"], {"value": F.col("value") + 1}, F.col("value") % 7 == 0, key="day", group="part").collect()
    assert sorted(r.day.day for r in got if not r.verified) == [7, 14, 21, 28]


def test_midstates_resume_anywhere():
    r = random.Random(3)
    kids = ["".join(digest(str(i), str(j)) for j in range(r.randint(1, 16))) for i in range(60)]
    whole, states = merkle.midstates(kids)
    assert whole == [digest(k) for k in kids]
    assert [len(s) for s in states] == [len(k) // 2 for k in kids]
    owner = np.array([i for i, k in enumerate(kids) for _ in range(len(k) // 64)])
    slots = np.array([s for k in kids for s in range(len(k) // 64)])
    new = [digest("new", str(i)) for i in range(len(owner))]
    want = [digest(kids[o][: 64 * s], d, kids[o][64 * s + 64 :]) for o, s, d in zip(owner, slots, new, strict=True)]
    assert merkle.resume(new, slots, kids, states, owner) == want
    # A fold reads nothing to the left of its slot but the state.
    spoilt = ["0" * 64 * s + kids[o][64 * s :] for o, s in zip(owner, slots, strict=True)]
    assert merkle.resume(new, slots, spoilt, [states[o] for o in owner], np.arange(len(owner))) == want


HOSTILE = [
    None, "", " ", "  \n\t ", "it's we'll I'M 'd 's", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "!!<|endoftext|", "<|endoftext|>  ", "x  <|endoftext|>y",
    "naïve ÄÖÜ 漢字 ١٢٣ ½ 🙂🙂 ​ x \x85y z \x1c.", "a" * 30_000, "ab " * 20_000, "1234567890" * 9, " " * 5000, "\r\n\r\n  x", "don't  stop\n\n\n",
]


@pytest.mark.parametrize("known", [tokencount.KNOWN, 3, 0])
def test_token_counts_equal_the_library(spark, known):
    from tokenizers import Tokenizer

    path = public_vocabulary("byte_bpe_50k.json")
    rows = [(i % 9, t) for i, t in enumerate(HOSTILE * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("r"), "key": F.lit(1), "n": F.lit(2.0)}).repartition(4)
    got = tokencount.count_tokens(docs, path, ["doc_id", "key", "row"], known=known).collect()
    library = Tokenizer.from_file(path)
    want = [(i, 1, "r", len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pieces_are_counted_once_per_distinct_pretoken(spark):
    docs = spark.createDataFrame([("the cat the dog",), ("the cat",), (None,)], "text string").na.fill("")
    path = public_vocabulary("byte_bpe_50k.json")
    got = {r.piece: r.seen for r in tokencount.distinct_counts(docs, path).collect()}
    assert got == {"the": 2, " cat": 2, " the": 1, " dog": 1}
    counts = tokencount.distinct_counts(docs, path).cache()
    assert set(tokencount.shared_by_many(counts, 2)) == {"the", " cat"}
    assert tokencount.shared_by_many(counts, 1) == {}
    assert len(tokencount.shared_by_many(counts, 4)) == 4


def test_token_counts_of_nothing_and_of_other_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_pretoken_counts(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.collect() == []
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.PreTokens(public_vocabulary("word_bpe_49k.json"))


def brute_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (x - s // n) - (s % n) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return ((n * x.astype(object) - s) ** 2).sum(axis=1), y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_equals_plain_numpy(spark, tmp_path):
    rng = np.random.default_rng(8)
    good = (rng.normal(size=(400, 40)) * np.linspace(0.2, 1, 40)).astype(np.float32).tolist()
    good[7] = good[8] = good[9]
    good[10] = [0.0] * 40
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[3]), (3, good[3])]
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 39), (903, [float("nan")] * 40), (904, [float("inf")] + [0.0] * 39), (905, [1.0] * 39), (906, [1e30] * 40)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "at": F.lit("x"), "component": F.lit(0)})
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_refined_whitening(spark, str(tmp_path)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == len(rows) * 32 and set(got["n"]) == {len(rows)}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-12
    deviation, white, explained = brute_whitening([v for _, v in rows])
    once = got[got["vec_id"].isin(range(400)) & (got["vec_id"] != 3)].sort_values(["vec_id", "component"])
    keep = [i for i in range(400) if i != 3]
    found = once["whitened"].to_numpy().reshape(-1, 32)
    assert np.allclose(found * np.sign((found * white[keep]).sum(axis=0)), white[keep], atol=1e-9)
    assert (once["deviation"].to_numpy().reshape(-1, 32)[:, 0] == deviation[keep].astype(np.int64)).all()
    assert np.allclose(once["explained"].to_numpy().reshape(-1, 32)[0], explained, rtol=1e-12)
    # The repeated rows and the null id have their results too.
    assert (got["vec_id"] == 3).sum() == 64 and got["vec_id"].isna().sum() == 32


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], kind)).collect()
    assert len(same) == 10 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(5, 0, None, None, None)}
    # Two of three components have no variance.
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0, float(i)]) for i in range(50)], kind)).toPandas()
    assert line[line["component"] == 1]["whitened"].std(ddof=0) == pytest.approx(1) and line[line["component"] > 1]["whitened"].isna().all()
    assert line["identity_error"].max() < 1e-12
    # Too large for a long, and exact just below.
    big = whitening.whiten(spark.createDataFrame([(0, [2.0**40]), (1, [0.0]), (2, [1.0])], kind)).collect()
    assert [r.deviation for r in big] == [None] * 3
    some = whitening.whiten(spark.createDataFrame([(0, [2.0**24]), (1, [0.0])], kind)).collect()
    assert {r.deviation for r in some} == {2**60}


@pytest.mark.parametrize("kind", ["spread", "clustered", "multiple", "deficient", "scaled"])
def test_refinement_reaches_double_precision(kind):
    rng = np.random.default_rng(4)
    values = {
        "spread": rng.random(40) + 0.01, "multiple": np.repeat([1, 0.5, 0.1, 0.01], 10), "deficient": np.r_[rng.random(10), np.zeros(30)],
        "clustered": np.r_[1 + 1e-9 * np.arange(20), 0.3 + 1e-12 * np.arange(10), rng.random(10) * 0.1], "scaled": 1e9 * rng.random(40),
    }[kind]
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigenpairs(a)
    size = values.max()
    assert np.abs(a @ x - x * e).max() < 2e-15 * size
    assert np.abs(x.T @ x - np.eye(40)).max() < 2e-15
    assert (np.diff(e) <= 0).all() and np.abs(e - np.sort(values)[::-1]).max() < 4e-15 * size
    # Single precision alone is far from it.
    y = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(y.T @ a @ y - np.diag(np.diag(y.T @ a @ y))).max() > 1e-9 * size
