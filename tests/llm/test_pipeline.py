import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm.test_decontamination import flat, least_edits, may_be_near
from tests.llm.test_near_copies import brute_classes
from tests.llm.test_packing import check_sequences, expected
from tests.llm.test_quality import rejected
from tests.llm.test_secrets import spans
from tidemark.llm.decontamination import EDIT_RATE
from tidemark.llm.secrets import PLACEHOLDER
from tidemark.llm.tokens import Encoder, public_tokenizer


def leaked(text, items):
    chars = flat(text or "")
    for item in items:
        if may_be_near(item, chars) and least_edits(item, chars) <= int(EDIT_RATE * len(item)):
            return True
    return False


def cleaned(text):
    out, end = "", 0
    for a, _, b, _ in spans(text):
        if a >= end:
            out += text[end:a] + PLACEHOLDER
        end = max(end, b)
    return out + text[end:] if out else text


def test_run_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect() if not rejected(r.text)]
    rows = [r for r, (key, first) in zip(rows, brute_classes(rows)) if key == first]
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(k, cleaned(t)) for k, t in rows if not leaked(t, items)]
    got = corpus_pipeline.run(spark, SF).collect()
    want = expected(Encoder(public_tokenizer()).tokenizer, rows)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_sequences(got)


def test_stages_on_edges(spark, edge, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, edge, SF).columns == edge.columns
        assert stage(spark, edge, SF).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
