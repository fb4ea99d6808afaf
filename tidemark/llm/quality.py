"""Quality rules as a short-circuit cascade.

Every rule is a rejecting condition.  Its cost and its rejections are estimated on a bounded sample; the cascade then
asks the rules in the order of rejections per second, each among the documents that the rules before it let through.
The order decides how much work is done and never what is kept: a document is kept if no rule rejects it.

Defined results: a null text has no words; texts with fewer than ``MIN_WORDS`` words fail the base measures; repeated
rows are judged alike, each on its own; an empty table gives an empty table; columns of the input that carry the names
of measures are left alone, because measures travel in a struct of their own.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import SPACES, let, words
from tidemark.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 512  # documents on which costs and rejections are estimated


@dataclass(frozen=True)
class Rule:
    """A named rejecting condition over ``text`` and the measures."""

    name: str
    rejects: Column


def n_chars(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` match a pattern of one character."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def default_rules(text: Column, m: Column) -> list[Rule]:
    """Rules over a text and its measures ``m``; all of them divide by words or letters without dividing."""
    text = F.coalesce(text, F.lit(""))
    return [
        Rule("upper_case", 10 * n_chars(text, r"\p{Lu}") > 3 * m["word_chars"]),
        Rule("exclamations", 10 * n_chars(text, "!") > 3 * m["n_words"]),
        Rule("symbols", 10 * m["n_symbols"] > 3 * m["n_words"]),
        Rule("duplicate_lines", 2 * m["n_dup_lines"] > m["n_lines"]),
        Rule("short_words", m["word_chars"] < 2 * m["n_words"]),
        Rule("long_words", m["word_chars"] > 25 * m["n_words"]),
    ]


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the text.

    Windows are compared by a 64-bit hash within one text.  Equal hashes become neighbours by sorting, so the work
    grows as n log n with the words of the text, whatever repeats in it.
    """

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(hashes, F.lit(1), F.size(w) - 2)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
                | F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]).otherwise(F.lit(False)),
            ),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        state = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            starts,
            state,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    none = F.lit(0).cast("bigint")
    return F.when(F.size(tokens) < 4, none).otherwise(
        let(
            let(tokens, windows),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)),
        )
    )


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns ``row`` (the input row), ``text``, ``number`` and ``m`` (its measures)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return (
        df.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
        .withColumn("words", words(F.col("text")))
        .withColumn("lines", lines)
        .select(
            "row",
            "text",
            F.monotonically_increasing_id().alias("number"),
            F.struct(
                F.size("words").cast("bigint").alias("n_words"),
                F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
                n_chars(text, SYMBOLS).cast("bigint").alias("n_symbols"),
                F.size("lines").cast("bigint").alias("n_lines"),
                (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                repeated_words(F.col("words")).alias("n_repeat_words"),
            ).alias("m"),
        )
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def cascade_order(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejections per cost, greedily: each place goes to the best rule for what the earlier ones let through.

    ``sample`` is small and stored.  A rule's cost is the time that counting its rejections takes beyond counting
    alone.  The rejections come as counts per combination of rules, of which there are at most as many as rows.
    """

    def seconds(condition: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count_if(condition)).collect()
        return time.perf_counter() - began

    floor = min(seconds(F.col("m").isNull()) for _ in range(2))
    cost = {r.name: max(seconds(r.rejects) - floor, 1e-3) for r in rules}
    flags = [r.rejects.alias(f"r{i}") for i, r in enumerate(rules)]
    groups = sample.select(*flags).groupBy(*(f"r{i}" for i in range(len(rules)))).count().collect()
    left, order = {tuple(g[:-1]): g[-1] for g in groups}, []
    rest = list(range(len(rules)))
    while rest:
        best = max(rest, key=lambda i: sum(n for key, n in left.items() if key[i]) / cost[rules[i].name])
        rest.remove(best)
        order.append(rules[best])
        left = {key: n for key, n in left.items() if not key[best]}
    return order


def quality_cascade(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Columns ``row``, ``text``, ``number``, ``m``, ``base_failed``, ``rejected_by`` (null if kept) and ``kept`` of every document.

    The cascade is one conditional expression, so a rule that is not reached is not computed.
    """
    scored = measured(df, text_col)
    rules = default_rules(F.col("text"), F.col("m"))
    sample = cut_lineage(measured(df.select(text_col).limit(sample_rows), text_col).filter(~base_failed(F.col("m"))))
    verdict = F.when(base_failed(F.col("m")), "base")
    for rule in cascade_order(sample, rules):
        verdict = verdict.when(rule.rejects, rule.name)
    judged = scored.withColumn("rejected_by", verdict)
    # The row's number keeps Catalyst from moving a filter on the verdict before the measures and repeating them there.
    kept = F.isnull("rejected_by") & (F.col("number") >= 0)
    return judged.withColumn("base_failed", base_failed(F.col("m"))).withColumn("kept", kept)
