"""Operators against brute force on small fixtures with nulls, empties, ties, copies and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackline.llm import archive, bpe, html, lines, neardup, neighbours, packing, quality, sharding, suffixes
from trackline.llm.common import connected, filter_computed, materialise
from trackline.llm.queries import op4_fuzzy_lines, public_vocabulary


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "be", "co", "du", "el", "fi", "gä"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage = prose(120, 1), prose(90, 2)
    near = base.split()
    near[60] = "other"
    out = [(0, base), (1, base), (2, " ".join(near)), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "two words"), (9, "x")]
    out += [(20 + i, f"{prose(40, 50 + i)} {passage} {prose(40, 90 + i)}") for i in range(6)]
    out += [(40, "ab" * 900), (41, prose(5000, 7)), (41, prose(5000, 7)), (42, "line one is here now\nline one is here now\n\nshort"), (None, prose(30, 8)), (None, base)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns carry names that operators use inside.
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"item": F.lit("a"), "key": F.lit(1), "part": F.lit(2.0), "rid": F.lit(3), "pos": F.lit("p"), "n": F.lit(None).cast("int")}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality(docs, rows, empty):
    got = {(r.doc_id, r.n_words): r for r in quality.ledger(docs).collect()}
    words = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
    assert sum(1 for _ in got) == len({(d, len(words(t))) for d, t in rows})
    for d, t in rows:
        w = words(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = got[d, len(w)]
        assert (r.word_chars, r.n_repeat_words) == (sum(map(len, w)), len(hit))
    entries = quality.ledger(docs)
    table = {r.rule: r for r in quality.ablation(entries, "prose/2").collect()}
    fails = [r.fail_bits & quality.mask("prose/2") for r in entries.select("fail_bits").collect()]
    assert table["few_words"].n_fail == sum(f & 1 for f in fails)
    assert table["few_words"].n_only == sum(f == 1 for f in fails)
    assert table["few_words"].kept == sum(f == 0 for f in fails)
    assert quality.ledger(empty).count() == 0


def test_quality_versions_and_clashing_names(spark):
    text = "\n".join(["the first line is said again here"] * 2 + [f"line {k} of some more words than that" for k in range(3)])
    df = spark.createDataFrame([(text, 1, 2, 3)], "text string, _t int, _w int, _q_t int")
    r = quality.ledger(df).first()
    assert (r.n_lines, r.n_dup_lines, r["_t"], r["_w"]) == (5, 1, 1, 2) and "_q_t" not in r.asDict()
    assert r.fail_bits >> 5 == 0
    text = "\n".join(["the first line is said again here"] * 2 + ["the second line is also said again"] * 2 + ["a third one"])
    r = quality.ledger(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.n_lines, r.n_dup_lines) == (5, 2) and r.fail_bits >> 5 == 1
    only = spark.createDataFrame([(32,), (96,)], "fail_bits long").select(quality.verdict("prose/2").alias("v2"), quality.verdict("prose/3").alias("v3"))
    assert [tuple(r) for r in only.collect()] == [(False, True), (False, False)]


def test_repeated_window_words(spark):
    text = "a b c d e x a b c d e f a b c d e"
    r = quality.measure(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.n_words, r.n_repeat_words) == (17, 15)


def test_sharding_moves_rows_only_into_the_new_shard(spark, empty):
    df = spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("_first", F.lit(7)).withColumn("_slot_first", F.lit(7))
    df = sharding.assign(sharding.assign(df, ["doc_id"], sharding.topology(8)), ["doc_id"], sharding.topology(9), "grown")
    got = sharding.number_slots(df, ["doc_id"]).toPandas()
    assert list(got.columns) == ["shard", "doc_id", "_first", "grown", "slot"] and (got["_first"] == 7).all()
    assert set(got[got["shard"] != got["grown"]]["grown"]) == {8}
    sizes = got.groupby("shard").size()
    assert sizes.min() > 2200 and sizes.max() < 2800
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert sharding.number_slots(sharding.assign(empty, ["doc_id"], sharding.topology(8)), ["doc_id"]).count() == 0


def test_sharding_weight_moves_stay_in_the_subtree(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    old = sharding.topology(8)
    new = [sharding.Shard(s.number, s.region, s.rack, 2.0 if s.number == 5 else 1.0) for s in old]
    got = sharding.assign(sharding.assign(df, ["doc_id"], old), ["doc_id"], new, "to").filter("shard <> `to`").toPandas()
    assert len(got) and (got["to"] >= 4).all()


def test_sharding_draws_are_recomputed_one_by_one(spark):
    """Every level's draws by plain Python, with hashes of another library."""
    import math

    import xxhash

    def draw(key, path, weight):
        seed = xxhash.xxh64_intdigest(path.encode(), seed=42)
        bits = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed=seed) >> 11
        return -math.log((bits + 0.5) / 2**53) / weight

    shards = [sharding.Shard(i, f"r{i % 3}", f"k{i % 2}", 1.0 + i % 4) for i in range(13)] + [sharding.Shard(13, "r0", "k0", 0.0)]
    got = {r.doc_id: r.shard for r in sharding.assign(spark.range(-50, 2000).withColumnRenamed("id", "doc_id"), ["doc_id"], shards).collect()}
    for key, shard in got.items():
        left, path = [s for s in shards if s.weight > 0], ""
        for level in ("region", "rack", "number"):
            below = {}
            for s in left:
                below.setdefault(str(getattr(s, level)), []).append(s)
            name = min(below, key=lambda n: draw(key, f"{path}/{n}", sum(s.weight for s in below[n])))
            left, path = below[name], f"{path}/{name}"
        assert left[0].number == shard


def test_copies_of_one_row_are_numbered_in_many_groups(spark, monkeypatch):
    rows = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit(1).alias("shard"), F.lit("x").alias("_slot_n")).repartition(6)
    seen = []
    monkeypatch.setattr(sharding, "materialise", lambda df, label: seen.append(materialise(df, label)) or seen[-1])
    got = sharding.number_slots(rows, ["doc_id"])
    assert sorted(r.slot for r in got.collect()) == list(range(5000)) and got.columns == ["shard", "doc_id", "_slot_n", "slot"]
    assert seen[0].groupBy("_slot_block").count().agg(F.max("count")).first()[0] < 20


def test_computed_filters_leave_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "_at long, _AT_ string, x string")
    assert [tuple(r) for r in filter_computed(df, F.col("_at") == 2).collect()] == [(2, "c", "d")]


def expected_components(rows, shingle, threshold):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset([tuple(w)] if 0 < len(w) < shingle else [tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)])))
    up = list(range(len(sets)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                up[root(i)] = root(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            names[root(i)].append(d)
    return Counter((d, len(s), min(names[root(i)], default=None) if s else d) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("shingle", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, shingle, threshold):
    got = neardup.near_duplicates(docs, shingle=shingle, threshold=threshold).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected_components(rows, shingle, threshold)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(empty).count() == 0


def test_odd_sketch_tells_the_differing_samples():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 32, (1, neardup.SAMPLES), dtype=np.uint32)
    for d in (0, 10, 40):
        two = one.copy()
        two[0, :d] += 1
        n = sum(int(x).bit_count() for x in (neardup.odd_sketch(one) ^ neardup.odd_sketch(two)).view(np.uint64)[0])
        z = neardup.WORDS * 64
        assert abs(n - z / 2 * (1 - np.exp(-4 * d / z))) <= 4 * (z / 4 * (1 - np.exp(-8 * d / z))) ** 0.5 + 1e-9


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(900, x) for x in range(901, 950)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.node: x.component for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_lines(spark, docs, empty):
    base = prose(20, 3)
    edited = base.split()
    edited[10] = edited[10][:-1] + "q"
    table = [(1, f"{base}\nonly here one two three four\nshort line"), (2, f"{base.upper()}!\nshort line"), (3, f"intro {prose(12, 4)}\n{' '.join(edited)}"), (4, None), (5, ""), (6, f"\n{base}\n")]
    got = {r.doc_id: r for r in lines.deduplicate_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got[1].text == table[0][1] and got[2].text == "short line" and (got[2].n_lines, got[2].n_removed) == (2, 1)
    assert got[4].text is None and got[5].text == "" and got[6].text == "\n"
    got = lines.deduplicate_lines(docs)
    assert got.count() == docs.count() and set(docs.columns) < set(got.columns)
    assert got.filter("doc_id = 42").first().text == "line one is here now\n\nshort"
    assert lines.deduplicate_lines(empty).count() == 0


def test_short_lines_are_deduplicated_exactly(spark, tmp_path):
    table = [(1, "Read more\n\n---\none two three four"), (2, "read MORE!\n\n---\none two three five"), (3, "Read more\nRead more"), (4, "Read mores")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in op4_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {1: table[0][1], 2: "\n---\none two three five", 3: "", 4: "Read mores"}


def test_simhash_is_the_majority_of_the_weighed_words(spark):
    import random as rnd

    for n in (1, 2, 5, 6, 14, 15, 40, 400):
        words = [f"w{rnd.Random(i).randrange(10**4)}" for i in range(n)]
        df = spark.createDataFrame([(words,)], "w array<string>").withColumn("o", lines.weighed(F.col("w")))
        r = df.select("o", lines.simhash(F.col("o")).alias("s"), F.transform("o", lambda w: F.xxhash64(w)).alias("h")).first()
        assert len(r.o) == min(len(set(words)), lines.WEIGHED) and r.o == sorted(r.o)
        ones = [sum(h >> b & 1 for h in r.h) for b in range(64)]
        assert r.s & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * ones[b] >= len(r.h))


def test_simhash_counts_all_votes_at_once(spark):
    def one_by_one(words):
        made_up = F.array(*[F.lit(-(k % 2)).cast("long") for k in range(1, lines.WEIGHED)])
        votes = F.concat(F.transform(words, lambda h: F.xxhash64(h)), F.slice(made_up, F.lit(1), F.lit(lines.WEIGHED) - F.size(words)))

        def count(a, carry):
            digits = []
            for k in range(4):
                digits.append(a[f"p{k}"].bitwiseXOR(carry).alias(f"p{k}"))
                carry = carry.bitwiseAND(a[f"p{k}"])
            return F.struct(*digits)

        return F.aggregate(votes, F.struct(*[F.lit(0).cast("long").alias(f"p{k}") for k in range(4)]), count, lambda a: a["p3"])

    words = F.transform(F.sequence(F.lit(1), (F.col("id") % lines.WEIGHED + 1).cast("int")), lambda k: F.xxhash64("id", k))
    df = spark.range(0, 20000, 1, 1).select(words.alias("w"))
    assert df.filter(lines.simhash(F.col("w")).eqNullSafe(one_by_one(F.col("w")))).count() == 20000
    plan = lambda code: df.select(code(F.col("w")))._jdf.queryExecution().toString()
    assert "aggregate(" in plan(one_by_one) and "aggregate(" not in plan(lines.simhash)


def test_fuzzy_line_links_need_the_edit_distance(spark):
    words = prose(60, 11).split()
    near, far = list(words), list(words)
    near[30] += "x"
    # The same words in another order have equal codes, but many edits between them.
    far = words[30:] + words[:30]
    table = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    assert _distance(table[0][1], table[2][1]) * 100 > lines.EDITS * len(table[0][1])
    got = {r.doc_id: r.n_removed for r in lines.deduplicate_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_long_lines_are_alike_by_the_edits_between_anchors(spark):
    """A bound that is never below the distance, and for long lines costs less than their characters."""
    import random as rnd
    import time

    rng, table = rnd.Random(8), [("", "")]
    for k in range(80):
        a = prose(rng.randint(5, 40), 700 + k).split()
        b = _edited(a, rng.choice([0.05, 0.15, 0.3]), rng)
        if k % 8 == 0:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        table.append((" ".join(a), " ".join(b)))
    told = F.struct(*[lines._let(F.split(c, " "), lambda w: lines.more_told(lines.told(w))).alias(c) for c in "ab"])
    bound = lines._let(told, lambda v: lines.edits_of_gaps(v["a"], v["b"], F.lit(10**6)))
    got = spark.createDataFrame(table, "a string, b string").select("a", "b", bound.alias("n"), lines.within_edits("a", "b").alias("ok")).collect()
    exact = [(r.n, _distance(r.a, r.b)) for r in got if r.n is not None]
    assert len(exact) > 60 and all(n >= d for n, d in exact) and sum(n == d for n, d in exact) > 40
    assert all(_distance(r.a, r.b) * 100 <= lines.EDITS * max(len(r.a), len(r.b)) for r in got if r.ok)
    a = [f"w{rng.randrange(10**6)}" for _ in range(2500)]
    b = [w if k % 8 else f"v{k}" for k, w in enumerate(a)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string")
    took = []
    for ok in (F.call_function("levenshtein", "a", "b", (F.length("a") * lines.EDITS / 100).cast("int")) >= 0, lines.within_edits("a", "b")):
        for _ in range(2):
            began = time.time()
            assert df.select(ok.alias("ok")).first().ok
        took.append(time.time() - began)
    assert took[1] < took[0] / 2, took


def test_bounds_tell_lines_with_moved_or_repeated_words(spark):
    """Two words that changed places leave the other anchors, and a long line that repeats itself is told by its parts."""
    a = [f"word{k}x" for k in range(60)]
    moved = [*a[:20], a[21], a[20], *a[22:40], "other", *a[41:]]
    once = [f"z{k}" for k in range(12)]
    period = [" ".join(["start", *once[:8], *(["end", *once[9:]] if drop else once[8:])]) for drop in (False, True)]
    table = [(" ".join(a), " ".join(moved)), *[(" ".join([period[0]] * n), " ".join([period[1]] * n)) for n in (3, 12)]]
    table += [(prose(80, 31), prose(90, 32)), ("", "abc"), ("a b", "")]
    df = spark.createDataFrame(table, "a string, b string")
    told = F.struct(*[lines._let(F.split(c, " "), lambda w: lines.more_told(lines.told(w))).alias(c) for c in "ab"])
    bound = lines._let(told, lambda v: lines.edits_of_gaps(v["a"], v["b"], F.lit(10**6)))
    got = df.select("a", "b", bound.alias("gaps"), lines.edits_of_parts(F.col("a"), F.col("b"), F.lit(10**6)).alias("parts"), lines.within_edits("a", "b").alias("ok")).collect()
    for r in got:
        d = _distance(r.a, r.b)
        assert r.parts >= d and (r.gaps is None or r.gaps >= d)
        assert r.ok == (bool(set(r.a.split()) & set(r.b.split())) and d * 100 <= lines.EDITS * max(len(r.a), len(r.b)))
    assert got[0].gaps is not None and got[0].gaps * 100 <= lines.EDITS * len(got[0].a)
    assert all(r.gaps is None and r.parts * 100 <= lines.EDITS * len(r.a) for r in got[1:3])


def test_sketches_tell_only_lines_that_share_too_few_words(spark):
    import random as rnd

    rng, table = rnd.Random(3), [("a b", "a b"), ("a a a b", "b c"), ("", "a")]
    for k in range(300):
        n = rng.choice([5, 20, 60, 400])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        table.append((" ".join(a), " ".join(w if rng.random() < k / 300 else f"v{rng.randrange(10**6)}" for w in a)))
    df = spark.createDataFrame(table, "a string, b string")
    got = df.select("a", "b", lines.sketch(F.col("a")).alias("x"), lines.sketch(F.col("b")).alias("y")).select("a", "b", lines.may_share("x", "y").alias("may"), lines.may_share("y", "x").alias("turned")).collect()
    enough = lambda a, b: len(a & b) * 100 >= max(len(a), len(b)) * lines.COMMON
    few = [r for r in got if not enough(set(r.a.split(" ")), set(r.b.split(" ")))]
    assert all(r.may == r.turned and (r.may or r in few) for r in got)
    assert len(few) > 100 and sum(not r.may for r in few) > len(few) / 2


def test_last_join_asks_only_for_likely_pairs(spark):
    """Unlike items of one bucket whose sketches tell them apart, but for one pair."""
    from trackline.llm.common import linked_groups, materialise

    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def alike(a, b):
        asked.add(1)
        return a == 28 and b == 29

    items = materialise(spark.createDataFrame([(i, (0,), [1]) for i in range(30)], "item long, sig struct<s: int>, buckets array<long>"), "likely")
    near = lambda x, y: F.expr(f"{x}.s = {y}.s")
    full = lambda d: d.select("item", F.col("item").alias("full"), F.least("item", F.lit(28)).alias("sketch"))
    likely = lambda x, y: F.col(x) == F.col(y)
    got = {r.node: r.component for r in linked_groups(items, near, full, alike, "likely", likely).collect()}
    assert got == {28: 28, 29: 28} and asked.value < 100


def test_linked_groups_find_every_link_of_crowded_buckets(spark):
    """Hundreds of items in one bucket, in groups that only their contents tell apart, against a plain version."""
    from trackline.llm.common import linked_groups, materialise

    n = 700
    table = [(i, (i % 7,), [1, 2] if i % 3 else [1, 3]) for i in range(n)]
    items = materialise(spark.createDataFrame(table, "item long, sig struct<s: int>, buckets array<long>"), "crowd")
    near = lambda x, y: F.expr(f"{x}.s = {y}.s")
    alike = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 7
    # Alike are i and i + 7 but for a gap, so each residue makes two chains.
    full = lambda d: d.select("item", (F.col("item") + F.when(F.col("item") >= 350, 100).otherwise(0)).alias("full"))
    got = {r.node: r.component for r in linked_groups(items, near, full, alike, "crowd").collect()}
    want = {i: i % 7 if i < 350 else 350 + (i - 350) % 7 for i in range(n)}
    assert got == want


def test_linked_groups_ask_for_each_pair_once(spark):
    """Unlike items that share two buckets, but for two of them, which share none."""
    from trackline.llm.common import linked_groups, materialise

    n = 30
    table = [(i, (0,), {0: [1], 1: [2]}.get(i, [1, 2])) for i in range(n)]
    items = materialise(spark.createDataFrame(table, "item long, sig struct<s: int>, buckets array<long>"), "once")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def unlike(a, b):
        asked.add(1)
        return False

    near = lambda x, y: F.expr(f"{x}.s = {y}.s")
    full = lambda d: d.select("item", F.col("item").alias("full"))
    assert linked_groups(items, near, full, unlike, "once").collect() == []
    assert n * (n - 1) // 2 - 1 <= asked.value < n * (n - 1) // 2 + n


def _edited(words, share, rng):
    """Words replaced, dropped, added or misspelt until the edits are near the share of the characters."""
    out, room = list(words), int(share * len(" ".join(words)))
    while True:
        k, kind = rng.randrange(len(out)), rng.randrange(4)
        if kind == 0:
            new, cost = [prose(1, rng.random())], None
        elif kind == 1:
            new, cost = [], len(out[k]) + 1
        elif kind == 2:
            new, cost = [out[k], prose(1, rng.random())], None
        else:
            at = rng.randrange(len(out[k]))
            new, cost = [out[k][:at] + "q" + out[k][at + 1 :]], 1
        cost = max(len(out[k]), len(" ".join(new))) if cost is None else cost
        if cost > room:
            return out
        room -= cost
        out[k : k + 1] = new


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


@pytest.mark.parametrize("low, high, least", [(5, 9, 0.9), (10, 19, 0.9), (20, 39, 0.9), (40, 99, 0.9), (100, 140, 0.9)])
def test_fuzzy_line_recall_by_length(spark, low, high, least):
    """Pairs within EDITS by brute-force edit distance are found, whatever their length."""
    import random as rnd

    rng, table, near = rnd.Random(low), [], []
    for k in range(60 if low < 40 else 25):
        words = prose(rng.randint(low, high), 9000 * low + k).split()
        a, b = " ".join(words), " ".join(_edited(words, rng.choice([0.1, 0.15, 0.2]), rng))
        if a != b and len(b.split()) >= 5 and _distance(a, b) * 100 <= lines.EDITS * max(len(a), len(b)):
            near.append(2 * k + 1)
        table += [(2 * k, a), (2 * k + 1, b)]
    got = {r.doc_id: r.n_removed for r in lines.deduplicate_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert len(near) > 15 and sum(got[i] for i in near) >= least * len(near)
    assert not any(got[2 * k] for k in range(len(table) // 2))


def test_bpe_equals_the_library(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_vocabulary("byte_bpe_50k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    odd = ["  a  b ", "a\n\n b", "x<|endoftext|> y <|endoftext|>", "\x1c a\x1d b", "a　 b", "é" * 300, "日本 😀😀", "don't I'LL", " " * 99 + "x", "ab" * 3000]
    mine = bpe.tokenizer(path)
    for t in [*odd, *[t or "" for _, t in rows]]:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want
        assert mine.decode(want) == theirs.decode(want, skip_special_tokens=False)
    clash = bpe.encode_documents(docs.withColumnsRenamed({"item": "_encoded", "key": "n_tokens"}), path, ids=False).collect()
    assert {r["_encoded"] for r in clash} == {"a"} and sorted(r.n_tokens for r in clash) == sorted(len(theirs.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    pieces = [p.encode() for p in list(mine.known)[:400]]
    by = defaultdict(list)
    for p in pieces:
        by[(len(p) - 1).bit_length()].append(p)
    assert all(mine.merge(g) == [mine.merge_one(p) for p in g] for g in by.values())
    got = bpe.encode_documents(docs, path)
    assert got.count() == docs.count() and all((r.text or "") == r.decoded and len(r.ids) == r.n_tokens for r in got.collect())
    assert bpe.encode_documents(empty, path).count() == 0


_HOSTILE = ["a", "B", "İ", "ı", "ſ", "Σ", "ß", "é", "e\u0301", "\u0958", "\ufb1d", "\u212b", "日", "😀", "7", "'s", "'", ",", ".", "!", "-", " ", " ", "  ", "\n", " \n", "\t", "\x1c", "\u00a0", "\u2003", "<|endoftext|>", "the", "Don"]


def test_tokenizers_equal_the_library_on_hostile_strings():
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(3)
    texts = ["İ,", "İ.", "aİ!", "\u0958,", "\ufb1d.", ", a", "a\n\nb", "\na", "a\n"]
    texts += ["".join(r.choice(_HOSTILE) for _ in range(r.randint(1, 12))) for _ in range(6000)]
    path = public_vocabulary("byte_bpe_50k.json")
    theirs, mine = tokenizers.Tokenizer.from_file(path), bpe.tokenizer(path)
    for t, (n, joined, raw) in zip(texts, mine.encode_batch(texts), strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert bpe._ids(joined) == want and n == len(want), t
        assert raw.decode("utf-8", "replace") == theirs.decode(want, skip_special_tokens=False), t
    path = public_vocabulary("word_bpe_49k.json")
    theirs, mine = tokenizers.Tokenizer.from_file(path), packing.WordIds(path)
    for t, raw in zip(texts, mine.encode_batch(texts), strict=True):
        assert list(np.frombuffer(raw, "<u4")) == [*theirs.encode(t, add_special_tokens=False).ids, 0], t


def test_word_ids_learn_letters_and_marks_apart(monkeypatch):
    """Words that end in any marks cost no piece of their own, also while the memory is turned over."""
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(packing, "MEMORY", 50)
    path = public_vocabulary("word_bpe_49k.json")
    theirs, mine = tokenizers.Tokenizer.from_file(path), packing.WordIds(path)
    r = random.Random(5)
    texts = [" ".join(prose(1, 10 * i + k) + "".join(r.choice(packing.MARKS) for _ in range(k % 4)) for k in range(9)) for i in range(60)] + ["", "\n", " ", "é\u0301$$ ß% Σ|>"]
    for i in range(0, len(texts), 7):
        for t, raw in zip(texts[i : i + 7], mine.encode_batch(texts[i : i + 7], 9), strict=True):
            assert list(np.frombuffer(raw, "<u4")) == [*theirs.encode(t, add_special_tokens=False).ids, 9], t
    assert mine.encode_batch([]) == []
    plain = packing.WordIds(path)
    plain.encode_batch(["house house, house.%%% house$$$ House***"])
    assert set(plain.stems) == {"house", "", ",", ".%%%", "$$$", "***"}


def test_word_ids_take_bounded_slices(monkeypatch):
    """A worker's memory follows a slice of some bytes, whatever number of long texts a batch holds."""
    monkeypatch.setattr(packing, "SLICE", 1000)
    texts = ["é" * 30, None, "word " * 500, "", "a b", "word " * 150, "word " * 60, "x" * 999, "y"]
    got = [s.to_pylist() for s in packing.slices(pa.array(texts))]
    assert sum(got, []) == [t or "" for t in texts] and len(got) == 3
    assert all(sum(len(t.encode()) for t in s[:-1]) < 1000 for s in got)
    assert list(packing.slices(pa.array([], pa.string()))) == []


def test_crossover_improves_on_its_first_parent():
    """Where best-fit decreasing wastes sequences, two islands with elite migration need fewer."""
    for seed in range(3):
        r = random.Random(seed)
        sizes = [r.randint(400, 1000) for _ in range(600)]
        first = packing._Bins(sizes, 2048)
        first.put(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
        elites = [packing.evolve(sizes, 2048, [], seed + k) for k in range(2)]
        best = packing.evolve(sizes, 2048, elites, seed + 2)
        assert sorted(i for b in best for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in best) and len(best) < len(first.bins)


def test_packing(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_vocabulary("word_bpe_49k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for d, t in rows:
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    got = packing.pack(packing.pieces_of(docs, path)).toPandas()
    whole = lambda x: None if x != x else int(x)
    assert Counter((whole(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1
    assert packing.pack(packing.pieces_of(empty, path)).count() == 0


def test_packing_over_several_blocks(spark):
    r = random.Random(5)
    sizes = [r.randint(1, 900) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(sizes)), "pid long, length long")
    got = packing.pack(df, block=100).toPandas()
    assert len(got) == 600 and got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= -(-sum(sizes) // 2048) + 2


def test_open_bins_of_all_blocks_meet_where_no_bin_can_be_full(spark):
    """Pieces of 1100 and 900 fill 2000 of 2048; no block has as many of one as of the other."""
    r = random.Random(6)
    sizes = [r.choice([1100, 900]) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "pid long, length long")
    got = packing.pack(df, block=40).toPandas()
    assert sorted(got["length"]) == sorted(sizes) and got["pid"].nunique() == 1000
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    ones = sizes.count(1100)
    assert got["sequence_id"].nunique() <= max(ones, -(-1000 // 2)) + 3
    alike = spark.range(300).select(F.col("id").alias("pid"), F.lit(1500).cast("long").alias("length"))
    assert packing.pack(alike, block=40).select("sequence_id").distinct().count() == 300


def test_crossover_keeps_every_piece():
    r = np.random.default_rng(2)
    sizes = sorted((int(x) for x in r.integers(1, 1500, 200)), reverse=True)
    best = packing.evolve(sizes, 2048, [], 1)
    assert sorted(i for b in best for i in b) == list(range(200)) and all(sum(sizes[i] for i in b) <= 2048 for b in best)
    first = packing._Bins(sizes, 2048)
    first.put(list(range(200)))
    assert packing.fitness(best, sizes, 2048) >= packing.fitness(first.bins, sizes, 2048)


def test_archives(spark):
    big = "<p>" + "é" * 700
    table = [(1, "u1", big), (2, "u2", big), (7, None, big), (3, "u3", "small"), (4, "u4", "small"), (5, "u5", None), (6, "a\r\nb", "\r\n\r\n" * 400), (None, "n", big), (8, "v", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    mono = archive.write_monolithic(archive.plan_records(pages))
    stored = archive.normalise(mono)
    got = archive.read_back(stored).collect()
    want = {(i, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in table}
    assert {(r.page_id, r.payload_digest, r.payload_bytes) for r in got} == want and len(got) == len(table)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == kinds[2] == ("revisit", 7) and kinds[7] == ("response", None) and kinds[3] == kinds[4] == ("response", None) and kinds[None] == ("response", None)
    assert {r.payload for r in got if r.page_id == 6} == {"\r\n\r\n" * 400}
    assert archive.read_back(archive.normalise(archive.write_monolithic(archive.plan_records(pages.limit(0))))).count() == 0


def test_inflate_reads_one_or_many_members():
    import gzip
    import io

    data = random.Random(1).randbytes(5_000_000)
    assert b"".join(archive.inflate(io.BytesIO(gzip.compress(data)))) == data
    assert b"".join(archive.inflate(io.BytesIO(gzip.compress(data[:9]) + gzip.compress(data[9:])))) == data


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = [(i, [float(np.float32(z)) for z in v]) for i, v in enumerate(x)]
    table += [(1000 + i, table[0][1]) for i in range(80)] + [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [None] * 24), (2004, [float("nan")] * 24), (2020, [1.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = neighbours.nearest(df, F.col("id") % 20 == 0, k=20).collect()
    good = {i: np.array(v) for i, v in table if i < 1080}
    hit = total = 0
    by = defaultdict(list)
    for g in got:
        by[g.query_id].append((g.rank, g.vec_id, g.score))
    assert set(by) == {i for i in good if i % 20 == 0}
    for q, found in by.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s - good[q] @ good[i]) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        best = sorted(((-round(float(good[q] @ v), 12), i) for i, v in good.items() if i != q))[:20]
        hit, total = hit + len({i for _, i in best} & {i for _, i, _ in found}), total + 20
    assert hit / total >= 0.9
    assert {i for _, i, _ in by[0]} == set(range(1000, 1020))
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = neighbours.nearest(df.filter("vec_id < 5"), F.col("id") % 20 == 0).collect()
    assert [g.vec_id for g in sorted(few, key=lambda g: g.rank)] == [i for _, i in sorted((-float(good[0] @ good[i]), i) for i in range(1, 5))]


def test_index_finds_every_code_within_the_radius():
    r = np.random.default_rng(9)
    codes = r.integers(0, 256, (3000, 8), dtype=np.uint8)
    codes[::3] = codes[0] ^ (r.random((1000, 8)) < 0.3).astype(np.uint8)
    index = neighbours._Index(codes)
    pop = np.array([bin(i).count("1") for i in range(256)])
    for radius in (0, 3, 8, 20, 27, 64):
        far = pop[codes ^ codes[0]].sum(axis=1)
        assert set(index.within(codes[0], radius)) == set(np.flatnonzero(far <= radius))


def test_extraction(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now</div>'
        "<article><header><h1>A &amp; B</h1></header><p>One   two<br>three <script>x<1</script>four<p>Five &eacute;<aside>no</aside>"
        '<section class="comments"><p>first!</p></section><form>mail</form></article><!-- <p>gone</p> --><footer>(c)</footer>'
    )
    assert html.main_text(page) == "A & B\nOne two three four\nFive é"
    long = "This is the text that was written by all of us and it is long enough for the rules to judge it by its words and not by its place."
    rules = f"<body><div>Menu <a href=x>one two three four</a></div><h2>Head</h2><p>{long}</p><p>Short.</p><p>{long}</p><div>Tiny</div><p><a href=y>{long}</a></p>"
    assert html.main_text(rules) == f"Head\n{long}\nShort.\n{long}"
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, page, "u"), (3, page, "u"), (4, "<p", "u"), (5, "<!-- open", "u")], "page_id long, html string, text string")
    got = html.extract(df).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 0), (3, 31), (3, 31), (4, 0), (5, 0)]
    assert html.extract(df.limit(0)).count() == 0


def test_extraction_judges_marked_and_unmarked_blocks():
    long = "This is the text that was written by all of us and it is long enough for the rules to judge it by its words and not by its place."
    odd = "Kebab lorem kobalt, rinde mosaik vulkan ambra tundra, pixel quarz silber onyx kupfer."
    links = "<p><a href=x>Cheap watches and shoes for sale</a></p><ul><li><a href=y>one</a></li><li><a href=z>two</a></li></ul>"
    teaser = "<article><h2><a href=x>Another story</a></h2><p>A few words on it.</p></article>"
    # The body is in a plain element, beside teasers, linked and not.
    assert html.main_text(f"<body>{teaser}<div>{long}</div><article><p>Coming soon.</p></article><div>{long}</div></body>") == f"{long}\n{long}"
    # Link lists and linked adverts inside go, odd and short text stays.
    for tag in ("article", "main"):
        assert html.main_text(f"<{tag}><h1>Head</h1><p>{long}</p>{links}<p>{odd}</p><p>{long}</p></{tag}>") == f"Head\n{long}\n{odd}\n{long}"
    # Alone, the tag decides for blocks that the rules leave open; without it they go.
    assert html.main_text(f"<nav>Menu</nav><article><p>{odd}</p><p>Short.</p></article>") == f"{odd}\nShort."
    assert html.main_text(f"<nav>Menu</nav><div><p>{odd}</p><p>Short.</p></div>") == ""
    # Short blocks follow decided ones of their container, wherever they stand in it; a box of its own beside it goes.
    assert html.main_text(f"<nav>Menu</nav><div><h1>Head</h1><p>{long}</p><p>End.</p></div><div>Tiny</div><footer>f</footer>") == f"Head\n{long}\nEnd."
    # Where all is short, a container's blocks are judged together.
    parts = ["This is the text.", "It was written by all of us.", "It is for you and not for them.", "That is all."]
    assert html.main_text("<nav>Menu</nav><div>" + "".join(f"<p>{p}</p>" for p in parts) + "</div><footer>f</footer>") == "\n".join(parts)


def stop_words_by_hand(pages):
    """Stop words from blocks of regular pages: <p> and <div> without links or classes, counted page by page."""
    used, n = Counter(), Counter()
    for page in pages:
        lang = re.search('lang="(..)"', page)
        lang = lang[1] if lang else ""
        texts = [x for x in re.findall(r"<p>([^<]*)", page) if len(x) >= 70]
        words = {w.strip(".,|") for x in texts for w in x.lower().split()} - {""}
        n[lang] += bool(words)
        used.update((lang, w) for w in words)
    weight = lambda lang, w: used[lang, w] + 20 * (w in html.STOP_WORDS)
    return {(lang, w) for lang in n if n[lang] for w in {v for k, v in used if k == lang} | html.STOP_WORDS if weight(lang, w) * 10 >= n[lang] + 20}


def test_stop_words_are_learned_by_language(spark, monkeypatch):
    r = random.Random(5)
    made = {lang: ["".join(r.choices(letters, k=r.randint(2, 4))) for _ in range(12)] for lang, letters in (("xx", "aeklmo"), ("yy", "irstuv"))}
    rare = lambda: "".join(r.choices("bcdfghnpqw", k=9))

    def passage(lang, n=24):
        return " ".join(r.choice(made[lang]) if r.random() < 0.45 else rare() for _ in range(n)) + "."

    def page(i):
        lang, other = ("xx", "yy") if i % 3 else ("yy", "xx")
        tag = "article" if i % 2 else "div"
        odd = f"<div><p>{passage(other)}</p></div>" if i % 25 == 0 else ""
        body = "".join(f"<p>{passage(lang)}</p>" for _ in range(3))
        return f'<html lang="{lang}"><body><nav>{passage(lang)}</nav>{odd}<{tag}><h1>Head</h1>{body}<p>End.</p></{tag}></body></html>'

    rows = [(i, page(i)) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "<p>" + "of the " * 200), (302, "<p>" + "of the " * 200), (303, f"<div>{'word ' * 400_000}")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("word", F.lit(7)).withColumn("lang", F.lit("q"))
    got = {(w.lang, w.word) for w in html.learned_words(df).collect()}
    # A bound on what a task counts before it hands it on changes nothing.
    monkeypatch.setattr(html, "COUNTED", 50)
    found = Counter()
    for part in html._usage(iter([df.select("html").toPandas()])):
        for lang, w, k in zip(part["lang"], part["word"], part["pages"], strict=True):
            found[lang, w] += k
    assert {k for k in got if k[0]} == {k for k in stop_words_by_hand(p for _, p in rows[:300]) if k[0]}
    assert got == {(lang, w) for (lang, w), k in found.items() if w and (k + 20 * (w in html.STOP_WORDS)) * 10 >= found[lang, ""] + 20}
    # The other language's passages go, whichever tag is around the text; the fixed words know neither language.
    out = html.extract(df)
    assert out.columns == ["page_id", "word", "lang", "text", "n_chars"]
    texts = {x.page_id: x.text for x in out.collect()}
    whole = lambda p: "\n".join(["Head", *re.findall(r"<p>([^<]*)", p)[-4:]])
    wrong = [i for i, p in rows[:300] if texts[i] != whole(p)]
    assert len(wrong) <= 6, wrong
    assert texts[300] == texts[301] == "" and texts[302] == ("of the " * 200).strip() and texts[303] == ""


def expected_removal(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))


@pytest.mark.parametrize("length", [40, 400])
def test_suffixes_bytes(docs, rows, empty, length):
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((d, len(t), n, s, k) for (d, _), t, (k, n, s) in zip(rows, texts, expected_removal(texts, length), strict=True))
    got = suffixes.remove_repeated(docs, length=length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert suffixes.remove_repeated(empty, length=length).count() == 0


def test_suffixes_words(spark):
    passage = prose(60, 21)
    table = [(i, f"{prose(30, 30 + i)}  {passage}\n{prose(30, 60 + i)}") for i in range(3)] + [(9, prose(80, 99))]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("lang", F.lit("x"))
    got = {r.doc_id: r for r in suffixes.remove_repeated(df, length=50, unit="words", keep=("lang",)).collect()}
    for i in range(3):
        assert bytes(got[i].kept).decode() == f"{prose(30, 30 + i)}  {prose(30, 60 + i)}" and got[i].lang == "x"
    assert bytes(got[9].kept).decode() == table[3][1]
