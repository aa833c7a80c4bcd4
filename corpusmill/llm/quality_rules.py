"""Quality rules as a ledger: every rule is evaluated once, its outcome is a bit, its figures are columns.

Policies are masks over the bits, so a new policy version, or leaving a rule out, needs no second look at the texts. All
of it is built-in column expressions inside the row; nothing is shuffled but the few distinct bit patterns of an ablation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, bind

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` (SQL over the measurements) is true; a null counts as not failed."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


#: Order is the order of the bits: append, never reorder.
RULES: tuple[Rule, ...] = (
    Rule("too_short", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("too_long", "n_words > 1000000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
)

BASE = ("too_short", "repeated_windows")
POLICIES: tuple[Policy, ...] = (
    Policy("base", 1, BASE),
    Policy("strict", 1, tuple(r.name for r in RULES)),
    Policy("default", 1, (*BASE, "too_long", "short_words", "long_words", "symbols", "repeated_lines")),
)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in names)


def _covered(pairs: Column) -> Column:
    """Words that repeated windows cover; ``pairs`` is (hash, place) of all windows of a text, sorted."""
    n = F.size(pairs)

    def again(x: Column, i: Column) -> Column:
        hash_at = lambda k: F.get(pairs, k)["h"]
        return ((i > 0) & (hash_at(i - 1) == x["h"])) | ((i < n - 1) & (hash_at(i + 1) == x["h"]))

    def sums(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return bind(F.array_sort(F.transform(F.filter(pairs, again), lambda x: x["p"])), sums)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of WINDOW words that a text holds more than once."""
    at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    windows = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def of(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), bind(pairs, _covered))

    return F.coalesce(F.when(F.size(hashes) >= WINDOW, bind(windows, of)), F.lit(0).cast("long"))


def rule_ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the measurements and ``failed``, a bit for each rule.

    Needs doc_id and text; other columns are ignored. A null text is empty; an empty one has no words or lines.
    One row per input row, repeated rows and null ids included.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    words = F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of_words = bind(words, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h).alias("n_repeat_words")))
    of_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    measured = base.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    measured = measured.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    bits = [F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def apply_policies(ledger: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with a column kept_<name>_v<version> for each policy."""
    return ledger.withColumns({f"kept_{p.name}_v{p.version}": F.col("failed").bitwiseAND(F.lit(mask(p.rules, rules))) == 0 for p in policies})


def ablations(ledger: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail only it, and are kept without it.

    Bit patterns are counted first (at most two to the number of rules), then taken apart bit by bit.
    """
    whole = mask(policy.rules, rules)
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r], rules)).alias("bit")) for r in policy.rules]))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.*").groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("fail"),
        count(F.col("bits") == F.col("bit")).alias("fail_only_this"),
        count(F.col("bits").bitwiseAND(F.lit(whole) - F.col("bit")) == 0).alias("kept_without"),
    )


def quality_verdicts(docs: DataFrame, policy: Policy = POLICIES[2]) -> DataFrame:
    """doc_id, the measurements, base_failed, failed (bits) and kept under a policy."""
    ledger = rule_ledger(docs)
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    kept = (F.col("failed").bitwiseAND(F.lit(mask(policy.rules))) == 0) & ~base
    return ledger.withColumn("base_failed", base).withColumn("kept", kept)
