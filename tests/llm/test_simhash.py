import numpy as np
import pytest
import xxhash

from tests.llm.conftest import COPY, SF
from tidemark.llm import queries as Q
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import RADIUS, forest, near_duplicates, one_of_each
from tests.llm.test_quality import WORD


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    """Smallest member that each value reaches."""
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in linked:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def brute(rows):
    """Smallest id that each (id, text) reaches."""
    prints = [fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= RADIUS]
    top = classes(range(len(rows)), near)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top[i]] = min(key, least.get(top[i], key))
    return [(key, prints[i], least.get(top[i])) for i, (key, _) in enumerate(rows)]


def order(row):
    return tuple((v is None, v or 0) for v in row)


def test_query_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = sorted((k, f"{f:016x}", c) for k, f, c in brute(rows))
    assert sorted(map(tuple, Q.op10_simhash_near_duplicates(spark, SF).collect())) == want


@pytest.mark.parametrize("limit", [1024, 2])
def test_edges(edge, empty, edge_rows, limit):
    want = brute([(r[0], r[1]) for r in edge_rows])
    got = [(r.id, r.fp % 2**64, r.component_id) for r in near_duplicates(edge, limit=limit).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert near_duplicates(empty).count() == 0


def test_hot_buckets_are_divided(spark):
    base = " ".join(f"common{i}" for i in range(400))
    rows = [(i, f"{base} tail{i}") for i in range(300)] + [(1000 + i, f"own{i} " * 5 + f"x{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in near_duplicates(df, limit=4).collect()}
    assert got == {k: c for k, _, c in brute(rows)}


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(5)
    values = []
    for centre in rng.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(20):
            value = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                value ^= 1 << int(bit)
            values.append(value)
    values = np.unique(np.array(values, dtype=np.uint64))
    keys = np.sort(rng.integers(0, 5, len(values))).astype("<i8")
    a, b = forest(keys, values.copy(), RADIUS)
    names = [int(v) for v in values]
    pairs = [
        (names[i], names[j])
        for i in range(len(names))
        for j in range(i)
        if keys[i] == keys[j] and (names[i] ^ names[j]).bit_count() <= RADIUS
    ]
    assert len(a) < len(names)
    assert classes(names, zip(map(int, a), map(int, b))) == classes(names, pairs)


def test_one_of_each(edge, empty, edge_rows):
    kept = one_of_each(edge)
    assert kept.columns == edge.columns
    rows = kept.select("doc_id", "text").collect()
    assert len({fingerprint(r.text) for r in rows}) == len(rows)
    assert {fingerprint(r.text) for r in rows} == {fingerprint(r[1]) for r in edge_rows}
    assert [r.doc_id for r in rows if r.text == COPY] == [1]
    assert one_of_each(empty).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (None, 1), (100, 3)] + [(i, i + 1) for i in range(200, 260)]
    links += [(1000 + i, 300) for i in range(200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [(a, b) for a, b in links if a is not None and a != b]
    assert got.items() >= {k: v for k, v in classes({v for p in clean for v in p}, clean).items() if k != v}.items()
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
