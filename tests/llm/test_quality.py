import re
from collections import Counter

import pytest

from tests.llm.conftest import SF
from tidemark.llm import queries as Q
from tidemark.llm.quality import quality_cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again)


def rejected(text):
    n, chars, symbols, dup, again = measures(text)
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    if n < 50 or 100 * again > 50 * n:
        return True
    upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", text or ""))
    return (
        10 * upper > 3 * chars
        or 10 * (text or "").count("!") > 3 * n
        or 10 * symbols > 3 * n
        or 2 * dup > len(lines)
        or chars < 2 * n
        or chars > 25 * n
    )


def test_query_against_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = Q.op6_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == measures(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert r.kept == (not rejected(texts[r.doc_id])), r.doc_id


def test_clean_labelled_documents_are_kept(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = Q.op6_quality_rules(spark, SF).join(labels, "doc_id").filter("not base_failed")
    assert judged.filter("quality = 1 and not kept").count() == 0
    assert judged.filter("quality = 0 and kept").count() == 0


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("WORD" + " WORDS".join(f" Q{i}X" for i in range(60)), "upper_case"),
        (" ".join(f"word{i}!!" for i in range(60)), "exclamations"),
        (" ".join(f"word{i}&&" for i in range(60)), "symbols"),
        ("\n".join(f"word{i}" + "x" * 40 for i in range(60)), "long_words"),
        (" ".join(chr(97 + i % 26) if i % 3 else chr(65 + i % 26) for i in range(60)), None),
        (" ".join(f"word{i}" for i in range(60)), "kept"),
    ],
)
def test_rules(spark, text, reason):
    row = quality_cascade(spark.createDataFrame([(text,)], "text string")).first()
    if reason == "kept":
        assert row.kept and row.rejected_by is None
    else:
        assert not row.kept
        assert reason is None or row.rejected_by == reason


def test_edges(edge, empty, edge_rows):
    rows = quality_cascade(edge).select("row", "m", "kept").collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r.kept == (not rejected(r.row.text))
        m = r.m
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == measures(r.row.text)
        assert r.row["kept"] == "extra kept"
    assert quality_cascade(empty).count() == 0


def test_main_path_is_native(spark):
    plan = Q.op6_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
