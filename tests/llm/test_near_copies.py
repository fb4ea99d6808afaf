import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import COPY, SF
from tests.llm.test_quality import WORD
from tests.llm.test_simhash import classes
from tidemark.llm.near_copies import RADIUS, near_copies, one_copy_of_each, simhash, similar_forest


def shingle_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows):
    """Smallest id that each (id, text) reaches over all pairs of similarity 0.8 or more; None for null ids alone."""
    sets = [shingle_set(t) for _, t in rows]
    holders, linked = defaultdict(list), []
    for i, s in enumerate(sets):
        common = Counter(j for one in s for j in holders[one])
        linked += [(i, j) for j, n in common.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
        linked += [(i, j) for j in range(i) if not s and not sets[j]]
        for one in s:
            holders[one].append(i)
    top = classes(range(len(rows)), linked)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top[i]] = min(key, least.get(top[i], key))
    return [(key, least.get(top[i])) for i, (key, _) in enumerate(rows)]


def order(row):
    return tuple((v is None, v or 0) for v in row)


def found(df, **options):
    return sorted(((r.id, r.component_id) for r in near_copies(df, **options).collect()), key=order)


def test_documents_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute_classes(rows)
    assert sum(k != c for k, c in want) > 5
    assert found(documents) == sorted(want, key=order)


def edited(rng, words, share):
    return " ".join(rng.choice("xyz") + str(rng.random()) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("block", [4096, 8])
def test_edited_copies_are_found(spark, block):
    rng, rows = random.Random(3), []
    for k in range(150):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 400))]
        rows += [(10 * k + j, edited(rng, words, share)) for j, share in enumerate([0, 0.005, 0.01, 0.02, 0.04])]
    hot = [f"h{rng.randrange(4000)}" for _ in range(300)]
    rows += [(10_000 + j, edited(rng, hot, 0.01)) for j in range(60)]
    want = sorted(brute_classes(rows))
    assert len({c for _, c in want}) < len(rows) / 2
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block) == want


def test_shared_passages_are_no_copies(spark):
    rng = random.Random(4)
    passage = " ".join(f"license{i}" for i in range(60))
    rows = [(k, passage + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(20 + k % 40))) for k in range(200)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), block=16) == sorted(brute_classes(rows))


def test_many_pairs_just_below_the_similarity(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(250)]
    rows = [(k, edited(rng, base, 0.035)) for k in range(250)]
    want = sorted(brute_classes(rows))
    assert 5 < len({c for _, c in want}) < 250
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), block=64) == want


def test_forest_joins_all_similar_pairs_of_a_bucket():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60)
    sets = [np.unique(np.where(rng.random(60) < 0.05, rng.integers(0, 2**63, 60), base)).astype("<i8") for _ in range(80)]
    keys = np.repeat([1, 2], 40)
    fps = np.array([simhash(s.view("<u8")) for s in sets]).view("<u8")
    a, b = similar_forest(keys, fps, np.array([len(s) for s in sets]), np.concatenate(sets), 0.8)

    def near(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        apart = int(np.bitwise_count(fps[i] ^ fps[j])) > RADIUS
        return keys[i] == keys[j] and not apart and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)

    pairs = [(i, j) for i in range(80) for j in range(i) if near(i, j)]
    assert all(near(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert classes(range(80), zip(a.tolist(), b.tolist(), strict=True)) == classes(range(80), pairs)
    assert len(a) == 80 - len(set(classes(range(80), pairs).values()))


def test_edges(edge, empty, edge_rows):
    want = sorted(brute_classes([(r[0], r[1]) for r in edge_rows]), key=order)
    assert found(edge) == want
    assert near_copies(empty).count() == 0
    kept = one_copy_of_each(edge)
    assert kept.columns == edge.columns
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len({shingle_set(r[1]) for r in edge_rows})
    assert {shingle_set(r.text) for r in rows} == {shingle_set(r[1]) for r in edge_rows}
    assert [r.doc_id for r in rows if r.text == COPY] == [1]
    assert one_copy_of_each(empty).count() == 0


def test_one_of_each_keeps_the_smallest_id(spark, documents):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = sorted(r.doc_id for r in one_copy_of_each(documents).collect())
    assert kept == sorted({c for _, c in brute_classes(rows)})
