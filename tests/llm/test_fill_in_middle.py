import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import tidemark.llm.fill_in_middle as fim
from tests.llm.conftest import LONG
from tidemark.llm.fill_in_middle import FORMS, Texts, fill_in_middle, restore, restored, transformed

ODD = ["", "a", "ab cd", "é", "éa bÉc", "<P>x", "<p>x", "a<S", ">b", "<", "M>", "😀😀 x1y2", "\x00\n\t", "<X> <PP> <P >", "z" * 999]


def plainly(name, text, seed=1):
    """One text, by slices of Python lists."""
    digest = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return name, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return name, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return name, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def made(df):
    return restore(fill_in_middle(df)).select("id", "n", "form", "prefix_chars", "middle_chars", "output", "text")


def test_edge_rows_against_plain_python(edge, edge_rows, rows):
    want = sorted((plainly(r[0], r[1]) for r in edge_rows), key=lambda r: [(v is None, str(v)) for v in r])
    assert rows(made(edge)) == want
    assert rows(made(edge.repartition(7))) == want


def test_every_document_and_every_form(documents):
    want = {r.doc_id: plainly(r.doc_id, r.text) for r in documents.collect()}
    got = {r.id: tuple(r) for r in made(documents).collect()}
    assert got == want
    assert {r[2] for r in got.values()} == set(FORMS)


def test_empty_table(empty):
    assert made(empty).collect() == []


def test_small_chunks_give_the_same(monkeypatch, spark):
    texts = [*ODD, "", "", LONG[:5000], "last"]
    whole = pa.array(texts)
    rng = np.random.default_rng(7)
    h = [rng.integers(0, 2**32, len(texts)) for _ in range(4)]
    want = transformed(Texts.of(whole), h, 10, 20)
    bounds = list(fim.slices(whole, 6))
    assert [b for _, b in bounds] == [a for a, _ in bounds[1:]] + [len(texts)]
    parts = [transformed(Texts.of(whole.slice(a, b - a)), [x[a:b] for x in h], 10, 20) for a, b in bounds]
    for k in range(4):
        assert np.concatenate([p[k] for p in parts]).tolist() == want[k].tolist()
    assert [t for p in parts for t in p[4].column().to_pylist()] == want[4].column().to_pylist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Z<>PSM\né😀", max_size=12), min_size=1, max_size=6), st.integers(0, 2**32 - 1))
def test_round_trip(texts, seed):
    rng = np.random.default_rng(seed)
    h = [rng.integers(0, 2**32, len(texts)) for _ in range(4)]
    n, form, prefix, middle, out = transformed(Texts.of(pa.array(texts)), h, 10, 50)
    assert restored(out, form).column().to_pylist() == texts
    for k, text in enumerate(texts):
        assert n[k] == len(re.findall("[A-Za-z]+|[^A-Za-z]", text))
        if form[k]:
            assert not re.search("<[PSM]>", text)
            a, b = prefix[k], prefix[k] + middle[k]
            parts = {"P": text[:a], "M": text[a:b], "S": text[b:]}
            assert out.column()[k].as_py() == "".join(f"<{x}>{parts[x]}" for x in ("PSM" if form[k] == 1 else "SPM"))


def test_a_damaged_output_is_refused():
    for output, form in (("<P>a<S>b", 1), ("<P>a<S>b<M>c<M>", 1), ("<S>b<P>a<M>c", 1), ("<P>a<S>b<M>c", 2)):
        with pytest.raises(ValueError):
            restored(Texts.of(pa.array([output])), np.array([form]))


def test_percentages_are_parameters(documents, rows):
    all_plain = fill_in_middle(documents, plain_percent=100)
    assert all_plain.filter("form <> 'plain' OR prefix_chars IS NOT NULL").count() == 0
    none_plain = fill_in_middle(documents.filter("text <> ''"), plain_percent=0, spm_percent=100)
    assert {r.form for r in none_plain.select("form").distinct().collect()} <= {"spm", "plain"}
    assert none_plain.filter("form = 'plain' AND NOT output RLIKE '<[PSM]>'").count() == 0
