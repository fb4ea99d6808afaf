import zlib

import pytest

from tests.llm.conftest import SF
from tidemark.llm import queries as Q
from tidemark.llm.toxicity import Model, chosen, fit, folded, measures, scored


@pytest.fixture(scope="module")
def larger():
    return SF.replace("0.001", "0.1")


def test_held_out_accuracy(spark, larger):
    rows = Q.op2_toxicity(spark, larger)
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    judged = rows.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in judged) / len(judged)
    found = [r.predicted for r in judged if r.toxic]
    assert right >= 0.97 and sum(found) / len(found) >= 0.85


def test_query(spark, documents):
    rows = Q.op2_toxicity(spark, SF).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_folding():
    assert folded("Ｉd1ot, ІDIΟT!\n$tup1d\u200b") == " idiot idiot stupid "
    assert folded("") == "  " and folded("\n\n") == "  "


def test_exceptions_and_length():
    automaton = Model({" clown ": 5.0, " moron": 4.0}, ["class clown"]).automaton()
    assert measures("a Clown", automaton)[2] > 0
    assert measures("the class clown", automaton) == (0.0, 0.0, 0.0)
    assert measures("class clown and a clown", automaton)[2] == measures("clown", automaton)[2]
    assert measures("m0r0nic", automaton)[0] > 0 and measures("clowns", automaton)[0] == 0
    short, long = measures("clown", automaton), measures("clown " + "x " * 500, automaton)
    assert short[0] == long[0] and short[1] > long[1]
    assert measures(None, automaton) == measures("", automaton) == measures("x", None) == (0.0, 0.0, 0.0)


def test_entries_are_words_where_they_can_be():
    counts = [(" tra", 7, 100), (" tras", 7, 99), (" trash ", 7, 98), (" low", 2.1, 120), (" lowei", 5, 90), (" loweia", 5, 30)]
    assert chosen([(f, float(w), t) for f, w, t in counts]) == {" trash ": 7.0, " lowei": 5.0}


def test_edges(spark, edge, empty, edge_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 1")):
        model = fit(edge, known)
        got = scored(edge, model).collect()
        assert sorted((r.id for r in got), key=str) == sorted((r[0] for r in edge_rows), key=str)
        assert all(0 <= r.score <= 1 for r in got)
        assert scored(empty, model).count() == 0
    assert 0 <= scored(edge, fit(empty, labels)).first().score <= 1
