import hashlib
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from tests.llm.conftest import LONG, SF
from tidemark.llm import queries as Q
from tidemark.llm.sentence_pieces import MARK, Pieces, decode, encode, pieces_of, runs, splits_at_marks
from tidemark.llm.tokens import public_tokenizer

MODEL = public_tokenizer("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", "a ", " a", "a  b", "\ta\nb\r\n", MARK, f" {MARK} a{MARK}b", "　y\xa0z", "<s>x</s> <unk> <0x41>",
    "\x00 \x1c", "😀 中文 👍🏽", "é ﬁ ǅ", "a" * 5000, " " * 333, f"{' ' * 40}x", "1234 56,7", "ab​cd  e",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def whole(library, text):
    return library.encode(text or "", add_bos=True, add_eos=True)


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_the_model_splits_at_marks():
    assert Pieces(MODEL).by_word


@pytest.mark.parametrize("limit", [200_000, 20, 0])
def test_documents_equal_the_library_whatever_the_table_holds(library, documents, limit):
    texts = ODD + [r.text for r in documents.collect()]
    pieces = Pieces(MODEL, limit)
    for at in range(0, len(texts), 30):
        part = texts[at : at + 30]
        found = pieces.encode(part)
        assert [unpacked(i) for i in found] == [whole(library, t) for t in part]
        assert pieces.decode(found) == [library.decode(whole(library, t)) for t in part]
        assert len(pieces.older) <= max(limit, 0) + 40_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab ▁\n\té中😀1.", max_size=30), max_size=4))
def test_any_text_equals_the_library(texts):
    pieces = pieces_of(MODEL)
    assert [unpacked(i) for i in pieces.encode(texts)] == [whole(pieces.library, t) for t in texts]


def test_models_that_cross_marks_take_whole_texts(library):
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    assert splits_at_marks(model)
    for change in (
        lambda m: m.pieces.add(piece=f"{MARK}of{MARK}the"),
        lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
        lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False),
        lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"),
        lambda m: setattr(m.trainer_spec, "model_type", m.trainer_spec.UNIGRAM),
    ):
        other = sentencepiece_model_pb2.ModelProto()
        other.CopyFrom(model)
        change(other)
        assert not splits_at_marks(other)
    pieces = Pieces(MODEL)
    pieces.by_word = False
    assert [unpacked(i) for i in pieces.encode(ODD)] == [whole(library, t) for t in ODD]


def test_edge_rows(library, edge, edge_rows, rows):
    made = decode(encode(edge, MODEL), MODEL).select("id", "n_tokens", "ids", "text")
    want = [(r[0], len(whole(library, r[1])), whole(library, r[1]), library.decode(whole(library, r[1]))) for r in edge_rows]
    got = [(r.id, r.n_tokens, unpacked(r.ids), r.text) for r in made.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[1] == LONG for r in edge_rows)


def test_empty_table(empty):
    assert decode(encode(empty, MODEL), MODEL).collect() == []


def test_query_equals_the_library(spark, library, documents):
    def digest(data):
        return hashlib.sha256(data).hexdigest()

    want = {}
    for r in documents.collect():
        ids = whole(library, r.text)
        want[r.doc_id] = (len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(library.decode(ids).encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op13_sentence_pieces(spark, SF).collect()}
    assert got == want


def test_runs_hold_every_row_once():
    assert list(runs([5, 0, 5, 20, 1], 10)) == [(0, 3), (3, 4), (4, 5)]
    assert list(runs([], 10)) == []
