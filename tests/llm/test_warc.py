import base64
import hashlib

from tests.llm.conftest import SF
from tidemark.llm import queries as Q
from tidemark.llm.warc import read_facts, read_records, write_archive
from tidemark.session import work_path


def expected(rows, least=0):
    """rows: (id, html); ids are distinct among equal payloads."""
    first = {}
    for key, html in rows:
        data = (html or "").encode()
        first[data] = min(first.get(data, key), key)
    for key, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and first[data] != key
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        yield key, len(data), digest, "revisit" if revisit else "response", first[data] if revisit else None


def test_query_against_brute_force(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, Q.op1_warc_archive(spark, SF).collect())) == sorted(expected(pages))


def test_copies_and_records(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (4, "u\r\nX: y", None), (6, "u6", ""), (7, "u7", "é" * 10)]
    df = spark.createDataFrame([(*r, "extra", "x") for r in rows], "page_id long, url string, html string, sha256 string, header string")
    for least in (0, 5):
        path = work_path(spark, "warc")
        write_archive(df, path, min_bytes=least)
        want = sorted(map(str, expected([(r[0], r[2]) for r in rows], least)))
        facts = read_facts(spark, path).collect()
        assert sorted(str((int(r[0]), r[1], r[2], r[3], r[4] and int(r[4]))) for r in facts) == want
        assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = {int(r.id): r for r in read_records(spark, path).collect()}
    for key, url, html in rows:
        r = records[key]
        assert bytes(r.payload).decode() == (html or "")
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1" and rest.endswith(b"\r\n\r\n")
        assert len(rest) - 4 == int(fields["Content-Length"])
        assert fields.get("WARC-Target-URI") == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
    assert len({bytes(r.record) for r in records.values()}) == len(rows)


def test_edges(spark):
    kinds = "page_id long, url string, html string"
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, "x"), (None, "b", "y"), (2, "c", "long" * 100_000)]
    path = work_path(spark, "warc")
    write_archive(spark.createDataFrame(rows, kinds), path)
    got = [(r.id, r.record_type, r.refers_to) for r in read_facts(spark, path).collect()]
    assert sorted(got, key=str) == sorted(
        [("1", "response", None), ("1", "revisit", "1"), (None, "revisit", "1"), (None, "response", None), ("2", "response", None)],
        key=str,
    )
    path = work_path(spark, "warc")
    write_archive(spark.createDataFrame([], kinds), path)
    assert read_facts(spark, path).count() == 0 and read_records(spark, path).count() == 0
