"""Quality rules: a ledger of rule bits and measurements, judged by versioned policies.

``ledger`` measures each text once and evaluates every rule once, giving one failure bit per
rule. A policy is a bit mask with a version; judging a ledger by another policy, or asking what
a policy would keep without one of its rules, needs only bitwise operations on stored bits.
Built-in column functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import SPACE_RUN, spaced_words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
_POS_BITS = 24


@dataclass(frozen=True)
class Rule:
    """``fails`` is a boolean column over the measurements; ``bit`` its place in the ledger."""
    name: str
    bit: int
    fails: Column = field(compare=False)


def default_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("few_words", 0, c("n_words") < 50),
        Rule("repeated_windows", 1, 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule("symbols", 2, 10 * c("n_symbols") > c("n_words")),
        Rule("shouting", 3, 100 * c("n_upper") > 30 * c("word_chars")),
        Rule("repeated_lines", 4, 100 * c("n_dup_lines") > 50 * c("n_lines")),
        Rule("long_words", 5, c("word_chars") > 40 * c("n_words")),
    ]


#: Policies by version: the names of the rules that reject. ``base`` is the fixed part of v1.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting"),
    "v2": ("few_words", "repeated_windows", "symbols", "shouting", "repeated_lines", "long_words"),
}


def policy_mask(version: str, rules: list[Rule] | None = None) -> int:
    bits = {r.name: r.bit for r in (rules or default_rules())}
    return sum(1 << bits[n] for n in POLICIES[version])


def _sum_steps(positions: Column) -> Column:
    """Words covered by 3-word windows that start at the sorted ``positions``."""
    steps = F.transform(positions, lambda p, k: F.coalesce(
        F.least(F.lit(3).cast("long"), F.get(positions, k + 1) - p), F.lit(3).cast("long")))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of ``text`` appended (null: no words, no lines).

    Columns of ``docs`` named like a measurement are replaced by it.

    Repeated windows: the hash of each 3-word window (its upper 40 bits) and its place are packed
    into one number and sorted, so equal windows are neighbours. Neighbours of equal hash are
    compared word by word; a text with a clash, or of more than 2^24 words, is sorted by the
    words themselves instead. So the count is exact, and no text is cut.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w, lines, s, pairs = F.col("_w"), F.col("_lines"), F.col("_s"), F.col("_pairs")
    at = lambda i: F.get(w, i)
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    low = F.lit(1 << _POS_BITS)
    packed = F.sort_array(F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(
        F.lit(-(1 << _POS_BITS))).bitwiseOR(i.cast("long"))))
    # neighbours of equal hash: their numbers differ in the low bits only
    twins = F.array_compact(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(
        F.shiftright(x.bitwiseXOR(y), _POS_BITS) == 0, F.struct(x.alias("x"), y.alias("y")))))
    place = lambda x: F.pmod(x, low).cast("int")
    same = lambda i, j: (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(
        pairs, lambda p: F.array(F.pmod(p.x, low), F.pmod(p.y, low))))))
    exact_sorted = F.sort_array(F.transform(starts, lambda i: F.struct(
        at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.cast("long").alias("i"))))
    eq = lambda x, y: F.coalesce((x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))
    exact = F.sort_array(F.transform(
        F.filter(F.col("_x"), lambda x, k: eq(x, F.get(F.col("_x"), k - 1)) | eq(x, F.get(F.col("_x"), k + 1))),
        lambda x: x.i))
    few = F.size(w) < F.lit(1 << _POS_BITS)
    return (
        docs.select(F.struct(*[c for c in docs.columns if c not in MEASURES]).alias("_row"), t.alias("_t"))
        .withColumn("_w", spaced_words(F.col("_t")))
        .withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("_s", F.when(few & (F.size(w) >= 3), packed).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_pairs", twins)
        .withColumn("_slow", ~few | F.exists(pairs, lambda p: ~same(place(p.x), place(p.y))))
        .withColumn("_x", F.when(F.col("_slow"), exact_sorted))
        .withColumn("_p", F.when(F.col("_slow"), exact).otherwise(places))
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", _sum_steps(F.col("_p")))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_upper", F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long"))
        .select("_row.*", *MEASURES))


def ledger(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``fail_bits``: bit r is set if rule r fails.

    One row per row of ``docs``, repeated rows included; columns of ``docs`` whose names clash
    with a measurement are replaced by it. Null texts have no words and fail ``few_words``.
    """
    rules = rules or default_rules()
    bits = [F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    # not a deterministic column, so a filter on it is not rewritten into copies of all measurements
    total = F.when(F.monotonically_increasing_id() >= 0, total)
    return measure(docs.drop("fail_bits"), text).withColumn("fail_bits", total)


def apply_policy(rows: DataFrame, version: str = "v1", rules: list[Rule] | None = None) -> DataFrame:
    """Ledger rows with ``base_failed`` and ``kept`` by the policy ``version``."""
    fails = lambda v: F.col("fail_bits").bitwiseAND(F.lit(policy_mask(v, rules))) != 0
    return rows.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(version))


def ablations(rows: DataFrame, version: str = "v1", rules: list[Rule] | None = None) -> DataFrame:
    """Per rule of a policy: rows that fail it, that only it rejects, and that stay without it.

    The ledger is first counted by its distinct bit patterns (at most 2^rules of them), so the
    report reads each row once however many rules and policies are compared.
    """
    rules = [r for r in (rules or default_rules()) if r.name in POLICIES[version]]
    mask = sum(1 << r.bit for r in rules)
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                               for r in rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return (counts.select("bits", "n", each)
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_only_this"),
                 F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without")))
