import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SF
from tidemark.llm import queries as Q
from tidemark.llm.packing import CAPACITY, Packing, best_fit, evolve, packed, pieces
from tidemark.llm.tokens import Encoder, public_tokenizer


@pytest.fixture(scope="module")
def library():
    return Encoder(public_tokenizer()).tokenizer


def expected(library, rows):
    found = []
    for key, encoding in zip([k for k, _ in rows], library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids = np.array([*encoding.ids, 0], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), CAPACITY)):
            part = ids[at : at + CAPACITY]
            found.append((key, n, at, len(part), zlib.crc32(part.tobytes())))
    return found


def check_sequences(rows):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(sequences)


def test_query_against_brute_force(spark, library, documents):
    rows = Q.op7_best_fit_packing(spark, SF).collect()
    want = expected(library, [(r.doc_id, r.text) for r in documents.collect()])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    least = -(-sum(r.length for r in rows) // CAPACITY)
    assert least <= check_sequences(rows) <= least + 1


def test_several_shards_and_rounds(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.choice([rng.randint(1, 300), rng.randint(300, 1500)]), i) for i in range(3000)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packed(parts, shard=300).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    least = -(-sum(r.length for r in got) // CAPACITY)
    assert check_sequences(got) <= least + 8


@pytest.mark.parametrize(("n", "shard", "sizes"), [(9000, 4096, (700, 900, 1100, 1300)), (4000, 1024, None), (2000, 250, (513, 600, 1400))])
def test_sequences_of_several_shards_against_plain_best_fit(spark, n, shard, sizes):
    rng = random.Random(n)
    lengths = [rng.choice(sizes) if sizes else rng.randint(1, 1500) for _ in range(n)]
    rows = [(i, 0, 0, length, i) for i, length in enumerate(lengths)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packed(parts, shard=shard).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    plain = best_fit(sorted(range(n), key=lambda i: -lengths[i]), lengths, Packing([], []), CAPACITY)
    assert check_sequences(got) <= len(plain.bins)


def test_edges(edge, empty, edge_rows, library):
    got = packed(pieces(edge, public_tokenizer())).collect()
    want = expected(library, [(r[0], r[1]) for r in edge_rows])
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    check_sequences(got)
    assert packed(pieces(empty, public_tokenizer())).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_evolution_beats_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(300, 1300) for _ in range(1000)]
    start = best_fit(sorted(range(1000), key=lambda i: -sizes[i]), sizes, Packing([], []), CAPACITY)
    best = evolve(sizes, CAPACITY, seed, [])
    assert sorted(i for members in best.bins for i in members) == list(range(1000))
    assert best.fills == [sum(sizes[i] for i in members) for members in best.bins] and max(best.fills) <= CAPACITY
    assert len(best.bins) <= len(start.bins)
