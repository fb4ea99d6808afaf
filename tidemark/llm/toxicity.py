"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs and digit substitutions to Latin letters, everything else to single spaces) and
matched by an Aho-Corasick automaton whose entries are whole words and beginnings of words.  An entry's weight is the log
of how much more often toxic than clean labelled texts have it.  A match inside an exception phrase does not count;
exceptions are the caller's phrases and words that begin like an entry and are at home in clean texts.  The sum of the
weights, as such and by length, gives the score through a logistic curve.

Labels are only used to fit: a bounded sample of at most ``TRAIN_ROWS`` labelled rows, half from each class where there
are as many, outside of the held-out rows.  One part of it gives lexicon and exceptions, the other the curve, so that the
curve has seen what the entries are worth on other texts.  Scores depend on the text alone.

Defined results: null and empty texts get the score of a text without matches; rows with equal texts have equal scores;
without labels of one class every score is the share of the other; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.session import cut_lineage

TRAIN_ROWS = 20_000  # labelled rows that are fitted on, at most
LEXICON = 500  # entries of the lexicon, at most
BEGINNINGS = range(3, 9)  # characters of the beginnings of words that may become entries
LEAST_WEIGHT = 2.0
LEAST_SHARE = 0.004  # of the toxic texts that an entry occurs in
COUNTED = 500_000  # features that a task counts before it passes them on
HELD_OUT = 5

# Letters of other scripts that look like Latin ones, and digits and signs that are read as letters.
HOMOGLYPHS = dict(
    zip(
        "авеѕіјкмнорстухԁɡһӏԛԝαβεικνορτυχіıſƒɑɩοⅼ", "abesijkmhopctyxdghlqwabeiknoptuxiisfaiol", strict=True
    )
)
SUBSTITUTES = dict(zip("0134578@$", "oieastbas", strict=True))
# Phrases in which words of the lexicon are harmless.
EXCEPTIONS = ("class clown", "clown fish", "trash can", "trash bin", "idiot proof", "lame duck", "stupid mistake")


def _folding() -> dict[int, str]:
    """What becomes of each code point below U+3000 after lower-casing; those that are not listed stay."""
    table = {}
    for code in range(0x3000):
        char = chr(code)
        if char in HOMOGLYPHS:
            table[code] = HOMOGLYPHS[char]
        elif char in SUBSTITUTES:
            table[code] = SUBSTITUTES[char]
        elif unicodedata.category(char) in ("Mn", "Me", "Cf"):
            table[code] = ""
        elif not char.isalnum():
            table[code] = " "
    for code in range(0xFF41, 0xFF5B):  # full-width letters
        table[code] = chr(code - 0xFF41 + 97)
    return table


FOLDING = _folding()


def folded(text: str) -> str:
    """Folded words with a space before, between and after them."""
    return " " + " ".join(text.lower().translate(FOLDING).split()) + " "


def features(text: str) -> set[str]:
    """Whole words (with the space after them) and beginnings of words of a folded text, each with the space before."""
    found = set()
    for word in set(text.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in BEGINNINGS if n <= len(word))
    return found


@dataclass
class Model:
    """Lexicon, exceptions and curve."""

    lexicon: dict[str, float]
    exceptions: Sequence[str]
    curve: Sequence[float] = field(default_factory=lambda: (0.0, 0.0, 0.0, 0.0))

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = folded(phrase)
            found.add_word(entry, (len(entry), None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def measures(text: str | None, automaton: ahocorasick.Automaton | None) -> tuple[float, float, float]:
    """Weight of a text's matches, that per hundred words, and the number of matches, each as log(1 + x)."""
    if not text or automaton is None:
        return 0.0, 0.0, 0.0
    flat = folded(text)
    hits, excused = [], []
    for end, (length, weight) in automaton.iter(flat):
        start = end - length + 1
        (excused if weight is None else hits).append((start, end, weight))
    if excused:
        spans = iter(excused)
        a, b = next(spans)[:2]
        kept = []
        for start, end, weight in sorted(hits):
            while b < end and (span := next(spans, None)):
                a, b = span[:2]
            if not (a <= start and end <= b):
                kept.append((start, end, weight))
        hits = kept
    best: dict[int, float] = {}
    for start, _, weight in hits:  # a word counts once, by its weightiest entry
        best[start] = max(best.get(start, 0.0), weight)
    total = sum(best.values())
    return math.log1p(total), math.log1p(100 * total / max(1, flat.count(" ") - 1)), math.log1p(len(best))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(HELD_OUT)) == 0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a logistic curve, the constant first, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) / weight.sum() - penalty @ beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + penalty
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def chosen(candidates: list[tuple[str, float, int]]) -> dict[str, float]:
    """Entries from candidates (feature, weight, toxic texts), the most telling first; none begins like another.

    An entry is as long as it can be while it keeps nine tenths of its texts: a word rather than its beginning.
    """
    weight, texts = {c[0]: c[1] for c in candidates}, {c[0]: c[2] for c in candidates}
    longer: dict[str, list[str]] = {}
    for name in texts:
        for k in range(2, len(name)):
            longer.setdefault(name[:k], []).append(name)
    lexicon: dict[str, float] = {}
    beginnings: set[str] = set()
    for name in sorted(texts, key=lambda f: (-weight[f] * texts[f], len(f), f)):
        if len(lexicon) == LEXICON:
            break
        if name in beginnings or any(name[:k] in lexicon for k in range(1, len(name) + 1)):
            continue
        same = [f for f in longer.get(name, []) if 10 * texts[f] >= 9 * texts[name]]
        name = max([name, *same], key=lambda f: (len(f), texts[f], f))
        lexicon[name] = weight[name]
        beginnings.update(name[:k] for k in range(1, len(name) + 1))
    return lexicon


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    exceptions: Sequence[str] = EXCEPTIONS,
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """A model from labelled rows that are not held out."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = cut_lineage(known)
    sizes = dict(known.groupBy("label").count().collect())
    prior = {k: sizes.get(k, 0) / max(1, sum(sizes.values())) for k in (0, 1)}
    part = [
        known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(train_rows // 2) for k in (0, 1)
    ]
    sample = cut_lineage(part[0].unionByName(part[1]))  # at most train_rows rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    train = rows.join(F.broadcast(sample), "id").dropDuplicates(["id"])
    for_curve = F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(3)) == 0
    train = cut_lineage(train.select("text", "label", for_curve.alias("for_curve")))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()

        def out() -> pd.DataFrame:
            names = list(toxic.keys() | clean.keys())
            frame = pd.DataFrame({"f": names, "t": [toxic[n] for n in names], "c": [clean[n] for n in names]})
            toxic.clear()
            clean.clear()
            return frame

        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                (toxic if label else clean).update(features(folded(text or "")))
                if len(toxic) + len(clean) > COUNTED:
                    yield out()
        yield out()

    part = train.filter("not for_curve")
    n_texts = {r["label"]: r["n"] for r in part.groupBy("label").agg(F.countDistinct("text").alias("n")).collect()}
    toxic, clean = n_texts.get(1, 0), n_texts.get(0, 0)
    if not toxic or not clean:
        share = prior[1]
        return Model({}, (), (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0, 0.0))
    counts = part.select("text", "label").dropDuplicates(["text", "label"]).mapInPandas(count, "f string, t long, c long")
    counts = cut_lineage(counts.groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    counts = counts.withColumn("w", weight)
    telling = counts.filter((F.col("t") >= max(3, LEAST_SHARE * toxic)) & (F.col("w") >= LEAST_WEIGHT))
    best = telling.orderBy((-F.col("w") * F.col("t")), "f").limit(40 * LEXICON)  # beginnings repeat one another
    lexicon = chosen([(r["f"], r["w"], r["t"]) for r in best.select("f", "w", "t").collect()])

    def begins_like_an_entry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[any(f[:k] in lexicon for k in range(1, len(f) + 1)) for f in frame["f"]]]

    at_home = counts.filter((F.col("c") >= 3) & (F.col("w") < 0.5) & F.col("f").endswith(" ")).select("f", "c")
    at_home = at_home.mapInPandas(begins_like_an_entry, "f string, c long").orderBy(F.desc("c"), "f").limit(LEXICON)
    model = Model(lexicon, [*exceptions, *(r["f"] for r in at_home.collect())])

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = model.automaton()
        for frame in frames:
            x = np.array([measures(t, automaton) for t in frame["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": frame["label"]})

    points = train.filter("for_curve").mapInPandas(measure, "a double, b double, c double, label int").toPandas()
    points = points.sort_values(["a", "b", "c", "label"])
    y = points["label"].to_numpy(dtype=float)
    share = np.array([max(1e-9, np.mean(y == k)) if len(y) else 1.0 for k in (0, 1)])
    by_row = np.where(y == 1, prior[1] / share[1], prior[0] / share[0])
    model.curve = tuple(logistic(points[["a", "b", "c"]].to_numpy(), y, by_row)) if len(y) else (0.0, 1.0, 0.0, 0.0)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id`` and ``score`` of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = StructType([rows.schema["id"], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, arrow = model.automaton(), to_arrow_schema(schema)
        constant, *slopes = model.curve
        for batch in batches:
            scores = []
            for text in batch.column(1):
                z = constant + sum(b * x for b, x in zip(slopes, measures(text.as_py(), automaton), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=arrow)

    return rows.mapInArrow(run, schema)
