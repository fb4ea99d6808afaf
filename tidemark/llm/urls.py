"""URL filter: rules by host and path, and a ratio of two character language models where no rule fits.

URLs that a rule judges train the models, those allowed one, those blocked the other.  A model is a Markov model of
variable order: a character's probability given the ``ORDER`` characters before it is interpolated over all shorter
contexts, each weighted by how often and with how many followers it was seen (Witten-Bell), so that contexts never seen
give way to shorter ones.  A URL's score is the difference of its two log-likelihoods divided by its characters.  A fifth
of the judged URLs is kept out of training; the threshold is the score that separates its two classes best.

Everything is counted over all URLs.  Only windows of ``ORDER + 1`` characters are counted over the text; counts of
shorter ones are sums of theirs.  Probabilities are computed once for each distinct window and joined to the URLs.  All
joins are merge joins, whatever Spark takes their sides to weigh, so the driver never holds one.

Defined results: a null URL, and one without ``://``, has an empty host and path and fits no rule; an empty URL scores 0;
without URLs of one class in training its model is uniform, and without both in the fifth the threshold is 0; equal URLs
have equal verdicts; an empty table gives an empty table; other columns travel in a struct of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
ORDER = 5
ALPHABET = 256  # characters among which a model without any evidence spreads its probability
START = "\x02"  # stands before the first character
HELD_OUT = 5  # one judged URL in so many calibrates the threshold
STEPS = 100  # thresholds per unit of score that are tried, up to LIMIT either way
LIMIT = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    name = verdict = F.when(F.lit(False), F.lit(""))
    for kind, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name, verdict = name.when(fits, rule), verdict.when(fits, kind)
    return name, verdict


def windows(urls: DataFrame, *columns: str) -> DataFrame:
    """A row for each character of ``url``: ``columns``, and ``w``, the character after the ``ORDER`` before it."""
    chars = F.concat(F.array_repeat(F.lit(START), ORDER), F.split("url", ""))
    filled = urls.filter("url <> ''").select(*columns, chars.alias("c"))
    places = F.sequence(F.lit(0), F.size("c") - ORDER - 1)
    window = F.transform(places, lambda i: F.concat(*(F.get(F.col("c"), i + k) for k in range(ORDER + 1))))
    return filled.select(*columns, F.explode(window).alias("w"))


def suffixes(window: Column) -> Column:
    """The last 1 to ``ORDER`` + 1 characters of a window, with the length of their context."""
    return F.explode(
        F.array(
            *(
                F.struct(F.lit(k).alias("k"), F.substring(window, ORDER + 1 - k, k + 1).alias("g"))
                for k in range(ORDER + 1)
            )
        )
    )


def merged(side: DataFrame) -> DataFrame:
    """``side`` for a join that must not broadcast either side.

    Spark weighs a stored table by its compressed files and exploded rows by those before ``explode``; in the memory of
    the driver, windows and grams take up to a hundred times that.
    """
    return side.hint("merge")


def models(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of all grams (``k``, ``g``), and totals and followers of their contexts (``k``, ``h``), for both classes."""
    allowed, blocked = (F.count_if(F.col("label") == kind) for kind in ("allow", "block"))
    whole = windows(train, "label").groupBy("w").agg(allowed.alias("a"), blocked.alias("b"))
    grams = whole.select(suffixes(F.col("w")).alias("s"), "a", "b").groupBy("s.k", "s.g")
    grams = cut_lineage(grams.agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    contexts = grams.groupBy("k", F.substring("g", F.lit(1), F.col("k")).alias("h")).agg(
        F.sum("a").alias("total_a"),
        F.count_if(F.col("a") > 0).alias("kinds_a"),
        F.sum("b").alias("total_b"),
        F.count_if(F.col("b") > 0).alias("kinds_b"),
    )
    return grams, cut_lineage(contexts)


def window_scores(distinct: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """Columns ``w`` and ``s``: the log-likelihood difference of the last character of each window."""
    parts = distinct.select("w", suffixes(F.col("w")).alias("s")).select("w", "s.k", "s.g")
    parts = parts.join(merged(grams), ["k", "g"], "left").withColumn("h", F.substring("g", F.lit(1), F.col("k")))
    parts = parts.join(merged(contexts), ["k", "h"], "left").fillna(0)
    rows = parts.groupBy("w").agg(
        F.sort_array(F.collect_list(F.struct("k", "a", "total_a", "kinds_a", "b", "total_b", "kinds_b"))).alias("p")
    )

    def log_probability(kind: str) -> Column:
        def longer(p: Column, x: Column) -> Column:
            seen = x[f"total_{kind}"] + x[f"kinds_{kind}"]
            return F.when(seen == 0, p).otherwise((x[kind] + x[f"kinds_{kind}"] * p) / seen)

        return F.ln(F.aggregate("p", F.lit(1.0 / ALPHABET), longer))

    difference = log_probability("a") - log_probability("b")
    return rows.select("w", difference.cast("decimal(18,9)").alias("s"))


def threshold_of(scored: DataFrame) -> float:
    """The score that separates the held-out classes best, from counts per step of the score."""
    step = F.floor(F.greatest(F.least(F.col("score") * STEPS, F.lit(LIMIT * STEPS)), F.lit(-LIMIT * STEPS)))
    counts = (
        scored.filter("label is not null")
        .groupBy(step.alias("step"))
        .agg(F.count_if(F.col("label") == "allow"), F.count_if(F.col("label") == "block"))
        .orderBy("step")
        .collect()
    )
    allowed, blocked = sum(r[1] for r in counts), sum(r[2] for r in counts)
    if not allowed or not blocked:
        return 0.0
    best, threshold, right_a, right_b = None, 0.0, allowed, 0
    for at, a, b in counts:  # steps below are blocked, this one and those above are allowed
        value = right_a / allowed + right_b / blocked
        nearer = best is not None and value == best and abs(at) < abs(threshold * STEPS)
        if best is None or value > best or nearer:
            best, threshold = value, at / STEPS
        right_a, right_b = right_a - a, right_b + b
    return threshold


def judged(df: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Columns ``row``, ``host``, ``path``, ``rule``, ``score`` (null where a rule judged) and ``verdict``."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), url.alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "label": verdict})

    held_out = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(HELD_OUT)) == 0
    urls = rows.groupBy("url").agg(F.max("label").alias("label"))
    urls = cut_lineage(urls.withColumn("train", F.col("label").isNotNull() & ~held_out))
    asked = urls.filter("not train").withColumn("n", F.monotonically_increasing_id())
    asked = cut_lineage(asked)
    grams, contexts = models(urls.filter("train"))
    places = windows(asked, "n")
    table = cut_lineage(window_scores(places.select("w").distinct(), grams, contexts))
    sums = places.join(merged(table), "w").groupBy("n").agg(F.sum("s").alias("s"))
    score = F.coalesce(F.col("s").cast("double") / F.length("url"), F.lit(0.0)).alias("score")
    scored = cut_lineage(asked.join(merged(sums), "n", "left").select("url", "label", score))
    threshold = threshold_of(scored)

    open_urls = cut_lineage(scored.filter("label is null").select("url", "score"))
    by_rule = rows.filter("label is not null").withColumn("score", F.lit(None).cast("double"))
    by_model = rows.filter("label is null").join(merged(open_urls), "url").select(*by_rule.columns)
    verdict = F.coalesce("label", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return by_rule.unionByName(by_model).select("row", "host", "path", "rule", "score", verdict.alias("verdict"))
