"""Secret scan with corpus-wide ownership.

Patterns name spans in each text.  The values of all spans are hashed, and the hashes are aggregated over the corpus
by distinct repositories and owners: a value that more than ``MAX_OWNERS`` owners hold is an example that people
copy, one with fewer owners looks live.  Base spans (assignments, access keys, hex strings) stay whatever the corpus
says and carry the verdict; general candidates (long mixed strings, private keys) become spans only if live.  A private
key is its header, body and END line, so owners are counted for each key and not for the header that all keys of a type
share; a header without an END line before the next header stands for itself.

Defined results: a null or empty text has no spans; every row is scanned on its own, repeated ids included; a null
owner or repository counts as one owner or repository; an empty table gives an empty table; the columns of the input
travel in one struct, so their names never clash.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import let
from tidemark.session import cut_lineage

MAX_OWNERS = 2
PLACEHOLDER = "[secret]"

# The patterns, in the order in which spans of equal start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
HEADER = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
BODY = r"(?:[^-]|-(?!----(?:BEGIN|END) ))*+"  # possessive, which Java matches without recursion
END = r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
KINDS = {
    "assign": (ASSIGN, 2, 6),  # pattern, group of the value, least length of the value
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
CANDIDATES = {
    "key": (HEADER + "(?:" + BODY + END + ")?", 0, 1),
    "mixed": (r"[A-Za-z0-9_-]{20,}", 0, 20),
}
ORDER = [*KINDS, *CANDIDATES]
BLOCK = 256  # values that a running fold appends one by one before it appends them as a block


def running(values: Column, zero: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each value of a non-empty array the fold of all values before it; the work grows with the array only."""
    none = F.array().cast("array<bigint>")

    def inside(state: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(state["now"].alias("now"), none.alias("out")),
            lambda a, v: F.struct(fold(a["now"], v).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out")),
        )

    def folded(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(
            blocks,
            F.struct(zero.cast("bigint").alias("now"), F.array().cast("array<array<bigint>>").alias("out")),
            lambda a, block: let(
                inside(a, block),
                lambda r: F.struct(r["now"].alias("now"), F.concat(a["out"], F.array(r["out"])).alias("out")),
            ),
            lambda a: F.flatten(a["out"]),
        )

    return let(values, folded)


def lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.length(s).cast("bigint"))


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern from left to right, without overlaps, whose value has the least length.

    Positions come from the lengths of the matches and of the text between them.
    """
    match_type = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,value:string>>"

    def placed(matches: Column, values: Column, gaps: Column) -> Column:
        def at(before_match: Column, before_gap: Column) -> Column:
            return F.filter(
                F.transform(
                    matches,
                    lambda m, i: F.struct(
                        (F.get(before_match, i) + F.get(before_gap, i + 1)).alias("start"),
                        F.lit(ORDER.index(kind)).alias("kind_no"),
                        (F.get(before_match, i) + F.get(before_gap, i + 1) + F.length(m)).alias("end"),
                        F.lit(kind).alias("kind"),
                        F.get(values, i).alias("value"),
                    ),
                ),
                lambda s: F.length(s["value"]) >= least,
            )

        total = running(lengths(matches), F.lit(0), lambda a, b: a + b)
        gap_total = running(lengths(gaps), F.lit(0), lambda a, b: a + b)
        return let(total, lambda x: let(gap_total, lambda y: at(x, y)))

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = let(every, lambda m: let(values, lambda v: let(F.split(text, pattern, -1), lambda g: placed(m, v, g))))
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(match_type)


def scanned(df: DataFrame, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """Columns ``row``, ``rid`` (a number of its own for each row), ``owner``, ``repository``, ``base``, ``extra``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.sort_array(F.concat(*(spans_of(text, k, *spec) for k, spec in KINDS.items())))
    extra = F.concat(*(spans_of(text, k, *spec) for k, spec in CANDIDATES.items()))
    telling = F.filter(  # a mixed string with few digits or without letters is a word or a number
        extra, lambda s: (s["kind"] != "mixed") | s["value"].rlike("(?s)^(?=.*[A-Za-z])(?:[^0-9]*[0-9]){3}")
    )

    def whole(s: Column) -> Column:
        return (s["kind"] == "key") & s["value"].rlike(END)

    def free(s: Column, others: Column) -> Column:
        return ~F.exists(others, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))

    # A whole key stays beside base spans that hit a part of it, and covers the mixed strings of its body.
    apart = let(
        F.col("base"),
        lambda b: let(
            F.filter("extra", whole),
            lambda keys: F.filter("extra", lambda s: whole(s) | (free(s, b) & free(s, keys))),
        ),
    )
    named = df.select(
        F.struct("*").alias("row"), owner.alias("owner"), repository.alias("repository"), F.col(text_col).alias("text")
    )
    return (
        named.withColumn("text", F.col("text").cast("string"))
        .select("row", "owner", "repository", base.alias("base"), telling.alias("extra"))
        .select("row", "owner", "repository", "base", apart.alias("extra"))
        .withColumn("rid", F.monotonically_increasing_id())
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """Columns ``hash``, ``n_owners``, ``n_repositories`` and ``live`` of every value in the corpus.

    Distinct repositories come first, so a value that is copied very often is reduced before every shuffle.
    """
    held = candidates.select("hash", "owner", "repository").distinct()
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("n_owners"),
        F.sum("n").alias("n_repositories"),
        (F.count("*") <= MAX_OWNERS).alias("live"),
    )


def secrets(
    df: DataFrame, text_col: str = "text", owner: Column | None = None, repository: Column | None = None
) -> DataFrame:
    """Columns ``row``, ``base`` and ``spans`` (all spans with their value's owners and whether it looks live)."""
    owner = F.col("source") if owner is None else owner
    repository = owner if repository is None else repository
    found = cut_lineage(scanned(df, text_col, owner, repository))
    every = F.explode(F.concat("base", "extra")).alias("s")
    values = found.select("rid", "owner", "repository", every).select(
        "rid", "owner", "repository", "s", F.unhex(F.md5("s.value")).alias("hash")
    )
    owners = cut_lineage(ownership(values))
    judged = (
        values.join(owners, "hash")
        .filter((F.col("s.kind_no") < len(KINDS)) | F.col("live"))
        .select(
            "rid",
            F.struct("s.start", "s.kind_no", "s.end", "s.kind", "s.value", "n_owners", "n_repositories", "live").alias("s"),
        )
    )
    spans = judged.groupBy("rid").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    some = F.size(F.concat("base", "extra")) > 0
    none = F.array().cast(spans.schema["spans"].dataType)
    with_spans = (
        found.filter(some).join(spans, "rid", "left").select("row", "base", F.coalesce("spans", none).alias("spans"))
    )
    return found.filter(~some).select("row", "base", none.alias("spans")).unionByName(with_spans)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with the placeholder for every run of overlapping spans; ``spans`` is sorted and not empty."""
    ends = F.transform(spans, lambda s: s["end"])

    def cut(before: Column) -> Column:
        kept = F.transform(
            spans,
            lambda s, i: F.when(
                s["start"] >= F.get(before, i),
                F.concat(
                    F.substring(text, (F.get(before, i) + 1).cast("int"), (s["start"] - F.get(before, i)).cast("int")),
                    F.lit(PLACEHOLDER),
                ),
            ).otherwise(F.lit("")),
        )
        last = F.array_max(ends)
        return F.concat(F.array_join(kept, ""), F.substring(text, (last + 1).cast("int"), F.lit(2**31 - 1)))

    return let(running(ends, F.lit(0), F.greatest), cut)


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = None, **options: Column) -> DataFrame:
    """The rows of ``df`` with all spans redacted, and ``chars_col``, if given, set to the new length."""
    found = secrets(df, text_col, **options)
    some = F.size("spans") > 0
    new = F.when(some, redacted(F.col(f"row.{text_col}"), F.col("spans"))).otherwise(F.col(f"row.{text_col}"))
    out = found.select("row", some.alias("some"), new.alias("new"))
    columns = []
    for field in df.schema.fields:
        column = F.col(f"row.`{field.name}`")
        if field.name == text_col:
            column = F.col("new")
        elif field.name == chars_col:
            column = F.when(F.col("some"), F.length("new")).otherwise(column)
        columns.append(column.cast(field.dataType).alias(field.name))
    return out.select(*columns)
