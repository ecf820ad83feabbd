"""Quality rules: every rule is evaluated once into a ledger of measurements and one failure bit per rule.

A policy is a version and the set of rules it enforces. It is applied to the stored ledger by one
bitwise test, so a new policy, or the effect of leaving one rule out, needs no second look at a text.
Only DataFrame functions run here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.common import SPACE, SPACES, WORD, column, fresh
from tallyshelf.operators.pick import once

#: Bit k of ``fail_bits`` is rule k. A bit keeps its meaning for ever; new rules get new bits.
RULES = (
    "few_words",        # under 20 words
    "repeated_words",   # over 30 % of the words in 8-word windows found twice or more
    "symbols",          # over one symbol in ten words
    "stutter",          # over 20 % of the words equal the word before
    "repeated_lines",   # over 30 % of the lines with a word equal an earlier line
    "word_length",      # words of under 2 or over 15 characters on average
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")
WINDOW = 8


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
#: Repeated lines and word length are measured but not enforced: lists, verse and scripts without spaces fail them.
PLAIN = Policy("plain-1", (*BASE.rules, "symbols", "stutter"))
STRICT = Policy("strict-1", RULES)


def _rules(m) -> list[Column]:
    """Failure of each rule in the order of RULES, in whole numbers; ``m`` gives a measurement."""
    return [
        m("n_words") < 20,
        100 * m("n_repeat_words") > 30 * m("n_words"),
        10 * m("n_symbols") > m("n_words"),
        100 * m("n_stutter") > 20 * m("n_words"),
        100 * m("n_dup_lines") > 30 * m("n_lines"),
        (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words")),
    ]


def measure(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """Add the struct ``into``: the measurements of one text and ``fail_bits``; see ``ledger``.

    Costly parts are evaluated once each. A window is known by a 64-bit hash of its words, compared
    only within its own text. The positions of repeated windows are sorted for texts that have any.
    """
    t, words, lines, hashes, order, hits = fresh(docs, "_t", "_words", "_lines", "_hashes", "_order", "_hits")
    kept = [column(c) for c in docs.columns]
    body = F.coalesce(column(text), F.lit(""))
    out = once(docs, words, F.filter(F.split(F.trim(body, F.lit(SPACES)), SPACE + "+"), lambda w: w != ""))
    w = column(words)
    n = F.size(w)
    out = once(out, hashes, F.transform(
        F.slice(w, 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])))
    out = once(out, lines, F.filter(F.split(body, "\n"), lambda line: line.rlike(SPACE.replace("[", "[^"))))
    out = out.select(*kept, hashes, F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(column(lines)))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x, i: (i > 0) & F.coalesce(x == F.get(w, i - 1), F.lit(False))))
        .cast("bigint").alias("n_stutter"),
    ).alias(t))
    h, s, p = column(hashes), column(order), column(hits)
    out = once(out, order, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(
        F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))))
    out = once(out, hits, F.when(s.isNotNull(), F.sort_array(F.transform(
        F.filter(s, lambda x, i: x["v"].eqNullSafe(F.get(s, i - 1)["v"]) | x["v"].eqNullSafe(F.get(s, i + 1)["v"])),
        lambda x: x["i"]))))
    repeats = F.coalesce(F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b), F.lit(0)).cast("bigint")
    out = once(out.select(*kept, t, repeats.alias(order)), hits, F.struct(
        *[column(order).alias(m) if m == "n_repeat_words" else column(t)[m].alias(m) for m in MEASURES]))
    measured = column(hits)
    bits = sum((F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
                for k, fails in enumerate(_rules(lambda m: measured[m]))), F.lit(0).cast("bigint"))
    return out.select(*kept, F.struct(*[measured[m].alias(m) for m in MEASURES], bits.alias("fail_bits")).alias(into))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, the measurements, ``fail_bits``. Store it; policies read it.

    Null and empty texts have no word, so they fail few_words and no rule that compares counts with
    each other. Repeated rows and null keys each keep their row; an empty table gives none; texts of
    any length are measured whole. Other columns of ``docs`` are left out and may have any name.
    """
    narrow = docs.select(column(key).alias("_key"), column(text).alias("_text"))
    return measure(narrow, "_q", "_text").select(F.col("_key").alias(key), "_q.*")


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def apply_policy(ledger_rows: DataFrame, policy: Policy, into: str = "kept") -> DataFrame:
    """Add the verdict of a policy to stored ledger rows."""
    return ledger_rows.withColumn(into, passes(F.col("fail_bits"), policy))


def keep(docs: DataFrame, policy: Policy = PLAIN, text: str = "text") -> DataFrame:
    """The documents a policy keeps, with the columns they came with."""
    (q,) = fresh(docs, "_q")
    return measure(docs, q, text).filter(passes(column(q)["fail_bits"], policy)).select(
        *[column(c) for c in docs.columns])


def ablation(ledger_rows: DataFrame, policy: Policy, by: Sequence[str] = ()) -> DataFrame:
    """What each rule of a policy does, from the ledger alone.

    Per rule (and ``by``): ``failed`` documents fail it, ``rescued`` fail no other rule of the policy
    and would be kept without it. Equal bits are counted together before the shuffle, so at most
    2^rules rows per group and task travel; an empty ledger gives no row.
    """
    mask = F.lit(policy.mask).cast("bigint")
    patterns = ledger_rows.groupBy(*by, F.col("fail_bits").bitwiseAND(mask).alias("_bits")).agg(
        F.count(F.lit(1)).alias("_n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("bigint").alias("bit"))
                      for r in policy.rules])
    one = patterns.withColumn("_r", F.explode(rules))
    return one.groupBy(*by, F.col("_r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("_bits").bitwiseAND(F.col("_r.bit")) != 0, F.col("_n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("_bits") == F.col("_r.bit"), F.col("_n")).otherwise(0)).alias("rescued"))
