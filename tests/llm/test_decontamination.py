import random

import pytest

from tests.llm.conftest import SF
from tidemark.llm import decontamination as D
from tidemark.llm import queries as Q
from tidemark.llm.decontamination import Q as GRAM
from tidemark.llm.decontamination import EDIT_RATE, contaminated, fold, gram_length, indexed, occurrences, strip, without_contaminated


def flat(text):
    return "".join(map(chr, strip(fold([text])[0][:-1])))


def least_edits(item, text):
    """Edits between the item and the part of the text that is nearest to it."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def may_be_near(item, text):
    """By the lemma the others are beyond the budget."""
    bound = len(item) + 1 - GRAM - GRAM * int(EDIT_RATE * len(item))
    return sum(item[k : k + GRAM] in text for k in range(len(item) - GRAM + 1)) >= bound


def test_query_finds_exactly_what_alignment_finds(spark, documents):
    """All documents against all items by plain alignment."""
    items = {r.item_id: flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: flat(r.text or "") for r in documents.collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in Q.op9_benchmark_decontamination(spark, SF).collect()}
    want = {}
    for doc, text in texts.items():
        for item, chars in items.items():
            if may_be_near(chars, text):
                edits = least_edits(chars, text)
                if edits <= int(EDIT_RATE * len(chars)):
                    want[doc, item] = edits
    assert got == want


@pytest.mark.parametrize("seed", range(40))
def test_edited_passages(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    item = " ".join(words[:30])
    edited = list(item)
    for _ in range(int(EDIT_RATE * len(item))):
        at, kind = rng.randrange(1, len(edited) - 1), rng.random()
        if kind < 0.34:
            edited[at] = rng.choice("klm")
        elif kind < 0.67:
            del edited[at]
        else:
            edited.insert(at, rng.choice("klm"))
    text = ", ".join(words[100:900]) + ". " + "".join(edited).upper() + "\n" + " ".join(words[1000:1500])
    found = list(occurrences(["nothing", text, ""], indexed([7], [item])))
    assert [f[:2] for f in found] == [(1, 7)]
    start, end, edits = found[0][2:]
    assert least_edits(item, flat(text[start:end])) <= int(EDIT_RATE * len(item)) and edits <= int(EDIT_RATE * len(item))
    assert list(occurrences([" ".join(words[30:2000])], indexed([7], [item]))) == []


def test_positions_are_code_points_of_the_original():
    item = "the quick brown fox jumps over the lazy dog and then it sleeps for a long long while"
    text = "  İ é 😀 -- " + item.upper().replace(" ", ",  ") + " !!! and more"
    ((row, k, start, end, edits),) = occurrences([text], indexed([1], [item]))
    assert (row, k, edits) == (0, 1, 0)
    assert text[start:end] == item.upper().replace(" ", ",  ")


def test_edges(spark, edge, empty, edge_rows):
    item = " ".join(f"copied{i}" for i in range(20, 40))
    bench = [(1, item), (2, item), (3, None), (4, ""), (5, "!?"), (None, item), (6, "this one is in no text at all")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    got = contaminated(edge, bench)
    with_copy = [r[0] for r in edge_rows if r[1] and item in r[1]]
    pairs = sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str)
    assert pairs == sorted(((d, i) for d in with_copy for i in (1, 2, None)), key=str)
    assert contaminated(edge, bench, block_chars=100).count() == got.count()
    clean = without_contaminated(edge, bench)
    assert clean.columns == edge.columns
    assert sorted(str(r.text) for r in clean.collect()) == sorted(str(r[1]) for r in edge_rows if item not in (r[1] or ""))
    assert without_contaminated(edge, bench, block_chars=100).count() == clean.count()
    assert contaminated(empty, bench).count() == 0 and contaminated(edge, bench.limit(0)).count() == 0
    assert without_contaminated(edge, bench.limit(0)).count() == len(edge_rows)


def letters(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n)).strip().ljust(n, "z")


def test_no_item_is_found_across_texts(spark):
    """An item over two and over three neighbouring rows, and one that lies in a row as a whole."""
    rng = random.Random(1)
    item = letters(rng, 130).replace(" ", "q")
    rows = [(1, letters(rng, 36) + item[:70]), (2, item[70:] + letters(rng, 40)), (3, item[:50]), (4, item[50:90]), (5, item[90:])]
    rows += [(6, item[:65]), (7, None), (8, ""), (9, item[65:]), (10, "x " + item + " y"), (11, item[: 130 - 13])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    for parts in (1, 7):
        dealt = docs.orderBy("doc_id").coalesce(1) if parts == 1 else docs.repartition(parts)
        assert sorted((r.doc_id, r.edits) for r in contaminated(dealt, bench).collect()) == [(10, 0), (11, 13)]
        kept = {r.doc_id for r in without_contaminated(dealt, bench).collect()}
        assert kept == set(range(1, 12)) - {10, 11}


@pytest.mark.parametrize("seed", range(6))
def test_texts_that_touch_in_a_chunk_against_plain_alignment(seed):
    """Short texts cut from edited items, all in one chunk, with items of 3 to 90 characters."""
    rng = random.Random(seed)
    items = [letters(rng, n) for n in (8, 9, 10, 11, 14, 20, 27, 33, 39, 40, 55, 90)]
    texts = []
    for item in items * 4:
        chars = list(item)
        for _ in range(rng.randint(0, 1 + len(item) // 10)):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        a, b = sorted(rng.sample(range(len(chars) + 1), 2)) if rng.random() < 0.5 else (0, len(chars))
        texts.append("".join(chars[a:b]))
    got = {(row, k): edits for row, k, _, _, edits in sorted(occurrences(texts, indexed(list(range(len(items))), items)), key=lambda r: -r[4])}
    want = {}
    for row, text in enumerate(texts):
        for k, item in enumerate(items):
            edits = least_edits(flat(item), flat(text))
            if edits <= int(EDIT_RATE * len(flat(item))):
                want[row, k] = edits
    assert got == want


def test_short_items_are_looked_for_as_whole_words():
    found = indexed([1, 2, 3, 4], ["Paris", "2+2=4", "a", "  "])
    texts = ["in Paris.", "comparison", "paris", "it is 2 + 2 = 4!", "12 2 4", "not A", "banana", "paris"]
    got = sorted((row, k) for row, k, *_ in occurrences(texts, found))
    assert got == [(0, 1), (2, 1), (3, 2), (5, 3), (7, 1)]
    assert [gram_length(n, n // 10) for n in (8, 10, 20, 30, 39, 40, 100)] == [8, 5, 6, 7, 8, 8, 8]


def test_results_do_not_depend_on_the_number_counted_together(monkeypatch):
    rng = random.Random(5)
    phrase = letters(rng, 40)
    items = [phrase + " " + letters(rng, 45) for _ in range(60)] + ["a" * 120]
    texts = [f"{phrase} {letters(rng, 50)} {items[k]} {phrase}" for k in range(0, 60, 7)] + ["a" * 700, "b" * 700]
    index = indexed(list(range(len(items))), items)
    want = sorted(occurrences(texts, index))
    assert {(row, k) for row, k, *_ in want if k < 60} == {(row, 7 * row) for row in range(9)}
    assert sum(k == 60 for _, k, *_ in want) >= 5
    for limit in (1, 1000, 50_000):
        monkeypatch.setattr(D, "HITS", limit)
        assert sorted(occurrences(texts, index)) == want


def test_a_phrase_that_thousands_of_items_share_stays_within_memory():
    import resource

    rng = random.Random(9)
    phrase = letters(rng, 30)
    items = [phrase + letters(rng, 90) for _ in range(3000)]
    text = " ".join(letters(rng, 250) + " " + phrase for _ in range(100)) + " " + items[77]
    index = indexed(list(range(3000)), items)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = list(occurrences([text], index))
    assert [(k, edits) for _, k, _, _, edits in found] == [(77, 0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB
