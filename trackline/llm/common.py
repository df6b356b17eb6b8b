"""What the operators share: tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The regular expression of the characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing, as in tests on one machine, a local folder is taken.
    """
    top = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not top:
        top = getattr(shared_folder, "own", "")
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            top = shared_folder.own = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    # What is written needs its shuffle files no more; Spark drops them when the driver collects garbage.
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or if df has such a column, a longer name that it has not."""
    has = {c.lower() for c in df.columns}
    while name.lower() in has:
        name += "_"
    return name


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by columns that are costly to compute.

    Pushed down, a filter would hold a copy of their expressions for each use, and the plan of nested ones would
    grow without end. A row number that the filter reads keeps it where it stands.
    """
    at = free_name(df, "_at")
    return df.withColumn(at, F.monotonically_increasing_id()).filter(condition & (F.col(at) >= 0)).drop(at)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.md5(F.coalesce(text, F.lit("")))


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of edges(a, b): node, component (the smallest node reachable).

    Each round points every node to its smallest neighbour, follows the pointers to their roots and
    contracts the edges, so the number of rounds is logarithmic. Hubs are only ever aggregated with
    min() (partial sums first) or joined against one row, which adaptive execution can split.
    Returns an empty table if there are no edges. Loops (a = b) are ignored.
    """
    edges = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    kind = edges.schema["a"].dataType
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        step = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")), label)
        # Pointers go to smaller nodes only, so following them ends; doubling keeps that short.
        while True:
            jump = step.select(F.col("u").alias("to"), F.col("to").alias("next"))
            longer = materialise(step.join(jump, "to").select("u", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")), label)
            discard(step)
            step = longer.select("u", "to")
            step._shared_path = longer._shared_path
            if longer.filter("moved").isEmpty():
                break
        if labels is None:
            new = step.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            ahead = step.select(F.col("u").alias("component"), "to")
            new = labels.join(ahead, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = materialise(new, label)
        left = step.select(F.col("u").alias("a"), F.col("to").alias("ra"))
        right = step.select(F.col("u").alias("b"), F.col("to").alias("rb"))
        smaller = edges.join(left, "a").join(right, "b").filter("ra <> rb")
        smaller = materialise(smaller.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), label)
        discard(edges, step, *([labels] if labels is not None else []))
        edges, labels = smaller, new
    discard(edges)
    if labels is None:
        spark = edges.sparkSession
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    return labels


#: Rounds in which the items of a bucket are held against a few of them, and how many these are.
STARS, LEADS = 3, 4
#: From the second round on, one in which fewer than one in so many pairs are alike is the last.
YIELD = 10
#: Items of one bucket that one task holds against each other; a larger bucket is dealt out in squares of this size.
SQUARE = 256


def _pair(x: DataFrame, on: str, sides: str) -> list[DataFrame]:
    """x once for each side, every column named for it, and its key named by the side alone."""
    return [x.select(F.col(on).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in x.columns if c != on]) for s in sides]


def linked_groups(items: DataFrame, near: Callable[[str, str], Column], contents: Callable[[DataFrame], DataFrame | list[DataFrame]], alike: Callable[[str, str], Column], label: str, likely: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Components of the items that share a bucket and are alike.

    items: item (long), sig (a struct), buckets (an array of different longs), in a table. near(x, y) is a cheap
    necessary condition on two columns of sigs. contents(items) gives item, full, as one table or as several to
    be written one after another, and alike(x, y) decides on two columns of these; it is asked only for items that the
    buckets leave open, and in the end once a pair, however many buckets its items share. With likely, contents has a
    column sketch as well, and likely(x, y) is another cheap necessary condition, on two columns of sketches.

    A bucket of two items is a pair, and buckets of the same items count once. All pairs of a larger bucket would
    grow with its square, so in a few rounds each of its items is held against the first of a few others that it
    is near to, and only buckets whose items are not of one component yet take part. What is left are items of
    different components; of these, rows that have a near partner are found by a semi join, and only they meet
    each other with both conditions inside the join, large buckets square by square. Each row knows all such buckets
    of its item, and with which items the rounds found it unlike, so a pair is decided in the least bucket that its
    items share, unless a round has decided it. So every link is found, and no join puts out anything but rows of
    items or links.
    Returns node, component for the items that have a link.
    """
    members = items.select(F.explode("buckets").alias("bucket"), "item")
    sets = members.groupBy("bucket").agg(F.min("item").alias("p"), F.max("item").alias("q"), F.count("*").alias("n")).filter("n > 1")
    sets = materialise(sets, label)
    sigs = items.select("item", "sig")

    def meet(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are near."""
        x, y = _pair(sigs, "item", "ab")
        return pairs.join(x, "a").join(y, "b").filter(near("sig_a", "sig_b")).select("a", "b")

    twos = materialise(meet(sets.filter("n = 2").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()), label)
    crowds = materialise(members.join(sets.filter("n > 2").select("bucket", "n"), "bucket").select("bucket", "n", "item"), label)
    alone = crowds.groupBy("bucket", "n").agg(*[F.bit_xor(F.xxhash64(F.lit(k), "item")).alias(f"x{k}") for k in (1, 2)]).groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket"))
    busy = materialise(crowds.join(alone.select("bucket"), "bucket").join(sigs, "item").select("bucket", "n", "item", "sig"), label)
    discard(sets, crowds)
    open_items = materialise(twos.select(F.col("a").alias("item")).union(twos.select("b")).union(busy.select("item")).distinct(), label)
    asked = contents(open_items)
    fetched = [materialise(part, label) for part in (asked if isinstance(asked, list) else [asked])]
    full = reduce(DataFrame.union, fetched)
    sketches, full = full.drop("full"), full.select("item", "full")
    discard(open_items)
    edges: list[DataFrame] = []
    asked_pairs: list[DataFrame] = []
    parts = None

    def add(pairs: DataFrame) -> bool:
        """Ask for pairs (a, b, own: whether a is the item that was held against another). Whether many are alike."""
        nonlocal parts
        x, y = _pair(full, "item", "ab")
        pairs = pairs.groupBy("a", "b").agg(F.max("own").alias("own"))
        said = materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "own", alike("full_a", "full_b").alias("ok")), label)
        asked_pairs.append(said)
        n, held = said.agg(F.count("*"), F.count_if("ok")).first()
        if held:
            edges.append(said.filter("ok").select("a", "b"))
            old, parts = parts, connected(reduce(DataFrame.union, edges), label)
            if old is not None:
                discard(old)
        return held * YIELD >= n

    def open_rows() -> DataFrame:
        """busy with part: the buckets that more than one component shares."""
        if parts is None:
            return busy.withColumn("part", F.col("item"))
        rest = busy.join(parts, F.col("item") == F.col("node"), "left").select(*busy.columns, F.coalesce("component", "item").alias("part"))
        mixed = rest.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("bucket")
        return rest.join(mixed, "bucket").select(*busy.columns, "part")

    first = twos.withColumn("own", F.lit(True))
    for star in range(STARS):
        rest = materialise(open_rows(), label)
        if rest.isEmpty():
            discard(rest)
            break
        lead = [F.min(F.struct(F.xxhash64(F.lit(LEADS * star + k), "item").alias("h"), "item", "part", "sig")) for k in range(LEADS)]
        leads = materialise(rest.groupBy("bucket").agg(F.array(*lead).alias("leads")), label)
        met = rest.join(leads, "bucket")
        # The first lead that an item is near to and not yet one with.
        chosen = F.coalesce(*[F.when((F.col("part") != F.col("leads")[k]["part"]) & near("sig", f"leads[{k}].sig"), F.col("leads")[k]["item"]) for k in range(LEADS)])
        pairs = met.select("item", chosen.alias("to")).filter("`to` IS NOT NULL").select(F.least("item", "to").alias("a"), F.greatest("item", "to").alias("b"), (F.col("item") < F.col("to")).alias("own"))
        many = add(pairs if first is None else pairs.union(first))
        first = None
        discard(rest, leads)
        if star and not many:
            break
    if first is not None:
        add(first)
    rest = open_rows()
    may = lambda x, y: near(f"sig_{x}", f"sig_{y}")
    sig = ["sig"]
    if likely is not None:
        rest = rest.join(sketches, "item")
        may = lambda x, y: near(f"sig_{x}", f"sig_{y}") & likely(f"sketch_{x}", f"sketch_{y}")
        sig = ["sig", "sketch"]
    squares = F.ceil(F.col("n") / SQUARE).cast("int")
    rest = rest.select("bucket", "item", "part", *sig, squares.alias("of"), F.pmod(F.xxhash64("item"), squares).cast("int").alias("own"))
    rest = materialise(rest, label)
    if not rest.isEmpty():
        others = F.explode(F.sequence(F.lit(0), F.col("of") - 1))

        def both(df: DataFrame) -> tuple[DataFrame, DataFrame]:
            x, y = df.withColumn("i", F.col("own")).withColumn("j", others), df.withColumn("j", F.col("own")).withColumn("i", others)
            return tuple(d.select(*[F.col(c).alias(f"{c}_{s}") for c in d.columns]) for d, s in ((x, "x"), (y, "y")))

        x, y = both(rest)
        apart = (F.col("bucket_x") == F.col("bucket_y")) & (F.col("i_x") == F.col("i_y")) & (F.col("j_x") == F.col("j_y")) & (F.col("part_x") != F.col("part_y"))
        some = x.join(y, apart & may("x", "y"), "left_semi").select(*[F.col(f"{c}_x").alias(c) for c in rest.columns])
        some = materialise(some.dropDuplicates(["bucket", "item"]), label)
        if not some.isEmpty():
            # An item has one pair of its own a bucket and round, so both lists are bounded by its buckets.
            shared = some.groupBy("item").agg(F.collect_list("bucket").alias("shared"))
            mine = F.when(F.col("own"), F.struct(F.col("a").alias("item"), F.col("b").alias("to"))).otherwise(F.struct(F.col("b").alias("item"), F.col("a").alias("to")))
            unlike = reduce(DataFrame.union, asked_pairs).filter("NOT ok").select(mine.alias("m")).groupBy("m.item").agg(F.collect_list("m.to").alias("unlike"))
            x, y = both(some.join(full, "item").join(shared, "item").join(unlike, "item", "left"))
            here = F.array_min(F.array_intersect("shared_x", "shared_y")) == F.col("bucket_x")
            known = F.coalesce(F.array_contains("unlike_x", F.col("item_y")), F.lit(False)) | F.coalesce(F.array_contains("unlike_y", F.col("item_x")), F.lit(False))
            links = x.join(y, apart & (F.col("item_x") < F.col("item_y")) & may("x", "y") & here & ~known & alike("full_x", "full_y"))
            held = materialise(links.select(F.col("item_x").alias("a"), F.col("item_y").alias("b")).distinct(), label)
            if not held.isEmpty():
                edges.append(held)
                old, parts = parts, connected(reduce(DataFrame.union, edges), label)
                if old is not None:
                    discard(old)
        discard(some)
    discard(busy, *fetched, twos, rest, *asked_pairs, *edges)
    if parts is None:
        return items.sparkSession.createDataFrame([], "node long, component long")
    return parts
