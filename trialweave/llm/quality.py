"""Rule bitmask ledger: every rule is evaluated once, policies and ablations read the stored bits.

A ledger row holds the measurements of a document and ``failed``, a number whose bit k says that rule k failed. A policy is a
named, versioned mask of rules; applying it or leaving out one of its rules is bit arithmetic on the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import SPACES, let, without, words


@dataclass(frozen=True)
class Rule:
    """``failed``: SQL over the measurements; never null."""

    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Their order gives the bits; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))


def repeat_words(found: Column) -> Column:
    """Words that stand in a three-word window which the text has twice or more.

    Windows are ordered by hash and place, so that equal ones meet; neighbours of one hash are compared word by word. The places
    of repeated windows, in order, each cover three words.
    """

    def repeated(w: Column, s: Column) -> Column:
        word = lambda x, k: F.get(w, x["i"] + k)
        same = lambda x, y: (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
        near = lambda x, j: F.coalesce((F.get(s, j)["h"] == x["h"]) & same(x, F.get(s, j)), F.lit(False))
        places = F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1))
        return F.sort_array(F.transform(places, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(p, start, step, lambda a: a["n"].cast("long"))

    def of_words(w: Column) -> Column:
        first = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        hashes = F.transform(first, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        ordered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = lambda h: F.size(F.array_distinct(h)) < F.size(h)
        count = lambda h: let(let(ordered(h), lambda s: repeated(w, s)), covered)
        return let(hashes, lambda h: F.when(some(h), count(h)).otherwise(F.lit(0).cast("long")))

    return let(found, of_words)


def measurements(text: Column, found: Column) -> dict[str, Column]:
    """Columns of ``MEASURES`` for a text and its words; all zero for null or no words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": F.length(F.array_join(found, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeat_words(found),
        "n_lines": F.size(lines).cast("long"),
    }


def ledger(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the measurements and ``failed``, the bits of the failed rules.

    A null or empty text has no words and fails the rules that ask for some. Equal rows get equal results. Columns of ``df``
    with the names of measurements, ``failed`` or ``__words`` are replaced. There is no shuffle.
    """
    if len(rules) > 62:
        raise ValueError("a ledger holds 62 rules at most")
    base = without(df, *MEASURES, "failed", "__words").withColumn("__words", words(F.col(text)))
    measured = base.withColumns(measurements(F.col(text), F.col("__words"))).drop("__words")
    bits = [F.when(F.expr(r.failed), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    place = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << place[name] for name in set(policy.rules))


def kept(policy: Policy, rules: tuple[Rule, ...] = RULES, failed: Column | None = None) -> Column:
    """Whether a ledger row passes every rule of the policy."""
    bits = F.col("failed") if failed is None else failed
    return bits.bitwiseAND(F.lit(mask(policy, rules))) == 0


def ablation(ledger_rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: documents that fail it, those it alone rejects, and those kept without it.

    The ledger is first counted by ``failed``, so that what is shuffled is bounded by the rule combinations and not by rows.
    """
    m = mask(policy, rules)
    place = {r.name: k for k, r in enumerate(rules)}
    combos = ledger_rows.groupBy("failed").agg(F.count("*").alias("n"))
    named = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << place[r]).alias("bit")) for r in sorted(set(policy.rules))]))
    each = combos.select("failed", "n", named.alias("r")).select("failed", "n", "r.*")
    hit = F.col("failed").bitwiseAND(F.lit(m))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(hit == F.col("bit"))("n_only"),
        count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("n_kept_without"),
    ).withColumns({"policy": F.lit(policy.name), "version": F.lit(policy.version)})
