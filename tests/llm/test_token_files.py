import random
import zlib

import numpy as np
import pytest

import tidemark.llm.token_files as token_files
from tests.llm.conftest import SF
from tidemark.llm import queries as Q
from tidemark.llm.token_files import Segment, encode_segment, read_documents, read_tokens, write_token_files
from tidemark.llm.tokens import Encoder, public_tokenizer
from tidemark.session import work_path

ODD = [
    "",
    "  ",
    "a b J̌ T̈ 'stan don't I'VE <|endoftext|>x <|ENDOFTEXT|> y",
    "İstanbul ΣΑΣ ﬁ ǅ 10,000.5€ 😀👍🏽\t\tx\r\n\x0bz w\x1c\x00q",
    "éa <| b",
    "x'S 'T it's_they'll",
    "中文 字 ガ 각",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_tokenizer())


def test_encoder_equals_the_library(encoder, documents):
    texts = ODD + [r.text for r in documents.collect()]
    for limit in (600_000, 50):
        encoder.limit = limit
        for at in range(0, len(texts), 40):
            part = texts[at : at + 40]
            ids, ends = encoder.encode(part)
            want = encoder.tokenizer.encode_batch(part, add_special_tokens=False)
            begins = np.r_[0, ends[:-1]]
            assert [ids[a:b].tolist() for a, b in zip(begins, ends)] == [e.ids for e in want]


@pytest.mark.parametrize("n", [1, 2, 3, 511, 512, 513, 5000])
def test_segment_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.integers(0, 16, n), rng.integers(0, 2**32, n), np.full(n, 2**32 - 1)):
        ids = ids.astype(np.uint32)
        segment = Segment(encode_segment(ids, np.array([n])))
        assert (segment.tokens() == ids).all()
        for i in rng.integers(0, n, 50).tolist():
            assert segment.token(i) == ids[i]
    with pytest.raises(IndexError):
        segment.token(n)


def expected(encoder, rows):
    start, found, flat = 0, [], []
    for key, text in rows:
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        found.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        flat.append(ids)
    return found, np.concatenate(flat)


def test_query_against_brute_force(spark, encoder, documents):
    want, _ = expected(encoder, sorted((r.doc_id, r.text) for r in documents.collect()))
    rows = Q.op3_token_files(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_random_access(spark, encoder, documents, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 5000)
    _, flat = expected(encoder, sorted((r.doc_id, r.text) for r in documents.collect()))
    path = work_path(spark, "tokens")
    write_token_files(documents, path, public_tokenizer())
    places = [random.Random(1).randrange(len(flat)) for _ in range(200)] + [0, 0, len(flat) - 1, len(flat) + 5]
    got = read_tokens(spark, path, spark.createDataFrame([(p,) for p in places], "at long")).collect()
    assert sorted((r.at, r.token) for r in got) == sorted((p, int(flat[p])) for p in places[:-1])


def test_edges(spark, encoder, edge, empty, edge_rows):
    path = work_path(spark, "tokens")
    write_token_files(edge, path, public_tokenizer())
    got = sorted(read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == sorted((r[0] for r in edge_rows), key=lambda v: (v is not None, v or 0))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    want, _ = expected(encoder, [(r[0], r[1]) for r in edge_rows])
    assert sorted(str((r.id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(str((k, n, c)) for k, _, n, c in want)
    path = work_path(spark, "tokens")
    write_token_files(empty, path, public_tokenizer())
    assert read_documents(spark, path).count() == 0
