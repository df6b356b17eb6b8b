"""Quality rules as a ledger: each rule is evaluated once, its failure is one bit.

The ledger keeps a bit mask and the measurements of every row. Policies are versioned sets of rules;
applying one, or asking what a rule adds to it, is bitwise work on the ledger and reads no text again.
Built-in functions only.

Defined results: a null or blank text has no words, so it fails `few_words`; rows are judged one by one,
so repeated rows and ties get equal results; an empty table gives an empty ledger. Extra columns stay;
a column with a name of the ledger is replaced, and names that begin with _q_ go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import SPACE, SPACE_CHARS

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, an SQL condition on the measurements, is true. Its bit never changes."""

    bit: int
    name: str
    fails: str


#: Integers only, so that every engine decides alike.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "n_symbols * 10 > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "repeated_lines", "n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(6, "mostly_repeated_lines", "n_lines > 3 AND 10 * n_dup_lines > 5 * n_lines"),
)
#: Policy versions by name; a version is never edited, a new one is added.
POLICIES = {
    "base/1": ("few_words", "repeated_windows"),
    "prose/1": ("few_words", "repeated_windows", "symbols", "short_words"),
    "prose/2": ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"),
    "prose/3": ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "mostly_repeated_lines"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of a policy's rules."""
    return sum(1 << r.bit for r in rules if r.name in POLICIES[policy])


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of each whole text.

    A window is five adjacent words. Windows are hashed first: a text whose hashes all differ repeats
    none, and only the others (equal windows always have equal hashes) sort their real windows.
    """
    keep = [c for c in docs.columns if c not in MEASURES and not c.startswith("_q_")]
    t = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_q_t"))
    t = t.withColumn("_q_w", F.when(_trimmed(F.col("_q_t")) == "", F.array().cast("array<string>")).otherwise(F.split(_trimmed(F.col("_q_t")), SPACE)))
    t = t.withColumn("_q_l", F.filter(F.split("_q_t", "\n"), lambda x: _trimmed(x) != ""))
    t = t.withColumn("_q_h", F.transform("_q_w", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.size("_q_w") - WINDOW)
    t = t.withColumn("_q_v", F.when(F.size("_q_w") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get("_q_h", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    t = t.select(
        *keep, "_q_w",
        F.size("_q_w").cast("long").alias("n_words"),
        F.length(F.array_join("_q_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_q_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_q_l").cast("long").alias("n_lines"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        (F.size(F.array_distinct("_q_v")) < F.size("_q_v")).alias("_q_again"),
    )
    whole = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("_q_w", i + 1, WINDOW), " ").alias("v"), i.alias("i")))
    t = t.withColumn("_q_s", F.when(F.col("_q_again"), F.sort_array(whole)))
    same = lambda x, j: F.coalesce(F.get("_q_s", j)["v"] == x["v"], F.lit(False))
    t = t.withColumn("_q_r", F.sort_array(F.transform(F.filter("_q_s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_q_r", start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_w", "_q_again", "_q_s", "_q_r")


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Evaluate every rule once: measurements and `fail_bits`."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs.drop("fail_bits"), text).withColumn("fail_bits", bits)


def verdict(policy: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a ledger row breaks no rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule adds to a policy: rows failing it, and rows that only it rejects. One aggregation of the ledger."""
    m = mask(policy, rules)
    chosen = [r for r in rules if r.name in POLICIES[policy]]
    got = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    sums = [F.count("*").alias("n"), F.count_if(got == 0).alias("kept")]
    for r in chosen:
        sums += [F.count_if(F.bit_get(got, F.lit(r.bit)) == 1).alias(f"f{r.bit}"), F.count_if(got == (1 << r.bit)).alias(f"o{r.bit}")]
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_fail"), F.col(f"o{r.bit}").alias("n_only")) for r in chosen])
    out = entries.agg(*sums).select("n", "kept", F.inline(rows))
    return out.select(F.lit(policy).alias("policy"), "rule", "n_fail", "n_only", "kept", (F.col("kept") + F.col("n_only")).alias("kept_without"))


def base_failed() -> Column:
    return ~verdict("base/1")
