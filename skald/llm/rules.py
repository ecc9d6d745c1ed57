"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; policies
are versioned masks over those bits, so a change of policy and ablations read the stored ledger and never the texts again.
The ledger is built-in expressions on one scan: no shuffle, no Python; an ablation is one aggregate over its bits.

Null texts have no words and every measurement 0; repeated rows get one ledger row each; empty tables give empty
ledgers. Columns of the input other than ``doc_id`` and ``text`` are carried only if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from skald.llm.common import SPACE, let, words

WINDOW = 3


def _windows(w: Column) -> Column:
    """Hashes of the 3-word windows, by position."""
    last = F.size(w) - WINDOW
    at = lambda i, k: F.get(w, i + k)
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first find included.

    Sorting the window hashes with their low bits replaced by the position leaves candidates side by side; only those
    are then compared as text, so hash collisions don't count and a text without repeats is sorted once as plain longs.
    """

    def of(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h)))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        sort = lambda high, low: F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i)))
        repeats = lambda low: let(sort(F.bitwise_not(low), low), lambda s: let(_candidates(s, low), lambda c: _covered(w, c)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(low, repeats))

    return let(_windows(w), of).cast("long")


def _candidates(s: Column, low: Column) -> Column:
    """Positions of windows whose hash, without the low bits, has an equal neighbour in the sorted array."""
    near = F.filter(s, lambda x, i: x.bitwiseXOR(F.get(s, i - 1)).between(0, low) | x.bitwiseXOR(F.get(s, i + 1)).between(0, low))
    return F.transform(near, lambda x: x.bitwiseAND(low).cast("int"))


def _covered(w: Column, candidates: Column) -> Column:
    text = lambda p: F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
    pairs = F.sort_array(F.transform(candidates, lambda p: F.struct(text(p).alias("t"), p.alias("p"))))

    def positions(a: Column) -> Column:
        same = F.filter(a, lambda x, i: (x["t"] == F.get(a, i - 1)["t"]) | (x["t"] == F.get(a, i + 1)["t"]))
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def length(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    return let(let(pairs, positions), length)


def occurrences(text: Column, chars: str) -> Column:
    """How often ASCII characters occur in all: plain replacement is far cheaper than a regular expression."""
    left = sum((F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))
    return (len(chars) * F.octet_length(text) - left).cast("long")


def capitals(text: Column) -> Column:
    """How many of A-Z a text holds."""
    return (F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")


def measures(text: Column, w: Column) -> dict[str, Column]:
    """The measurements, by name. ``w``: the words of ``text``."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": occurrences(text, "#*$%&|<>"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": repeat_words(w),
        "n_lines": F.size(F.split(text, "\n")).cast("long"),
        "n_shouts": occurrences(text, "!"),
        "n_upper": capitals(text),
        "n_digits": (F.octet_length(text) - F.octet_length(F.translate(text, "0123456789", ""))).cast("long"),
        "n_bullets": F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("^[ \t]*[-*\u2022]"))).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` holds over the measurements."""

    name: str
    fails: str


#: A rule's place is its bit; append new rules, never reorder.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("exclamations", "2 * n_shouts > n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("digits", "2 * n_digits > word_chars"),
    Rule("bullets", "10 * n_bullets > 9 * n_lines"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_short", "repeated_windows"))
#: strict-1 had no rule against capitals: its "shouting" was what is now "exclamations".
STRICT_2 = Policy("strict-2", ("too_short", "repeated_windows", "symbols", "duplicate_lines", "exclamations", "word_length", "shouting"))
STRICT = Policy("strict-3", (*STRICT_2.rules, "digits", "bullets"))


def ledger(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, the measurements and ``failed_bits``; a row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    m = let(F.struct(text.alias("t"), words(text, SPACE).alias("w")), lambda q: F.struct(*(c.alias(n) for n, c in measures(q["t"], q["w"]).items())))
    out = docs.select("doc_id", *carry, m.alias("_m")).select("doc_id", *carry, "_m.*")
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(BIT[r.name])).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of ``policy``: documents that fail it, that only it rejects, and what is kept without it."""
    mask = F.lit(policy.mask)
    got = F.col("failed_bits").bitwiseAND(mask)
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(got == 0).alias("_kept")]
    for r in policy.rules:
        aggs += [F.count_if(got.bitwiseAND(F.lit(BIT[r])) != 0).alias(f"_f_{r}"), F.count_if(got == BIT[r]).alias(f"_o_{r}")]
    cells = [
        F.struct(F.lit(policy.version).alias("policy"), F.lit(r).alias("rule"), F.col(f"_f_{r}").alias("n_failed"), F.col(f"_o_{r}").alias("n_only"), (F.col("_kept") + F.col(f"_o_{r}")).alias("n_kept_without"), F.col("_n").alias("n_docs"))
        for r in policy.rules
    ]
    return rows.agg(*aggs).select(F.inline(F.array(*cells)))
