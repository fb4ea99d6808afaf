import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import decode, text
from tidemark.functions.predicates import predicate
from tidemark.functions.types import TSQL_TYPES, extract_schema


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def raw(value: bytes):
    return F.unhex(F.lit(value.hex()))


@pytest.mark.parametrize(
    ("value", "expected"), [(b"TRUE", True), (b"true", True), (b"FALSE", False), (b"1", False), (b"", False)]
)
def test_boolean(spark, value, expected):
    assert one(spark, decode.boolean(raw(value))) is expected


@pytest.mark.parametrize(("value", "expected"), [(b"42", 42), (b"-7", -7), (b"x", 0), (b"", 0), (b"3000000000", 0)])
def test_integer(spark, value, expected):
    assert one(spark, decode.integer(raw(value))) == expected


@pytest.mark.parametrize(("value", "expected"), [(b"9223372036854775807", 2**63 - 1), (b"9223372036854775808", 0)])
def test_large_integer(spark, value, expected):
    assert one(spark, decode.large_integer(raw(value))) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (b"20240229123456.0Z", dt.datetime(2024, 2, 29, 12, 34, 56)),
        (b"20240102030405", dt.datetime(2024, 1, 2, 3, 4, 5)),
        (b"20230229123456.0Z", None),
        (b"2024010203", None),
        (b"", None),
    ],
)
def test_generalized_time(spark, value, expected):
    assert one(spark, decode.generalized_time(raw(value))) == expected


def test_text_survives_malformed_bytes(spark):
    assert one(spark, decode.text(raw("Hello World".encode()))) == "Hello World"
    assert one(spark, decode.text(raw(b"a\xc3(b"))) == "a�(b"


def sid_bytes(authority, *parts):
    return bytes([1, len(parts)]) + authority.to_bytes(6, "big") + b"".join(p.to_bytes(4, "little") for p in parts)


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (sid_bytes(5, 21, 3623811015, 3361044348, 30300820, 1013), "S-1-5-21-3623811015-3361044348-30300820-1013"),
        (sid_bytes(5, 18), "S-1-5-18"),
        (sid_bytes(1), "S-1-1"),
        (sid_bytes(5, 18)[:-1], "AQEAAAAAAAUSAAA="),
        (b"\x02\x00\x00\x00\x00\x00\x00\x05", "AgAAAAAAAAU="),
    ],
)
def test_sid(spark, value, expected):
    assert one(spark, decode.sid(raw(value))) == expected


def test_guid(spark):
    value = uuid.UUID("a1b2c3d4-e5f6-7890-abcd-ef1234567890")
    assert one(spark, decode.guid(raw(value.bytes_le))) == str(value)
    assert one(spark, decode.guid(raw(b"abc"))) == "YWJj"


def test_hash_id_is_the_md5_of_utf16(spark):
    import hashlib

    expected = str(uuid.UUID(bytes_le=hashlib.md5("Täble.Cölumn".encode("utf-16-le")).digest()))
    assert one(spark, text.hash_id(F.lit("Täble"), F.lit("Cölumn"))) == expected


@pytest.mark.parametrize("value", ["0", "-1", "", "abc", None, "2650467744000000000"])
def test_filetime_without_a_time(spark, value):
    assert one(spark, decode.filetime(F.lit(value).cast("string"))) is None


def test_filetime(spark):
    micros = one(spark, F.unix_micros(decode.filetime(F.lit("133456789012345678"))))
    assert micros == (133456789012345678 - 116444736000000000) // 10
    early = one(spark, F.unix_micros(decode.filetime(F.lit(116444735999999999))))
    assert early == -1


def test_deleted_filetime(spark):
    for value, expected in [("1", True), ("0", False), ("x", False), (None, False)]:
        assert one(spark, decode.is_deleted_filetime(F.lit(value).cast("string"))) is expected


def test_account_flags(spark):
    assert len(decode.ACCOUNT_FLAGS) == 22
    assert one(spark, decode.account_flags(F.lit(0x0202))) == ["AccountDisabled", "NormalAccount"]
    assert one(spark, decode.account_flags(F.lit(0))) == []
    assert one(spark, decode.account_flags(F.lit(2**31 - 1))) == list(decode.ACCOUNT_FLAGS)


@pytest.mark.parametrize(
    ("length", "expected"),
    [(10, 16), (13, 16), (14, 16), (15, 32), (100, 128), (375, 450), (376, 512), (3334, 4000), (3335, None), (0, None), (None, None)],
)
def test_length_bucket(spark, length, expected):
    assert one(spark, text.length_bucket(F.lit(length).cast("int"))) == expected
    if length and expected:
        assert int(length * 1.2) <= expected


@pytest.mark.parametrize("value", ["", "plain", "Café", "a😀b", "日本"])
def test_text_measures(spark, value):
    assert one(spark, text.utf16_length(F.lit(value))) == len(value.encode("utf-16-le")) // 2
    assert one(spark, text.has_unicode(F.lit(value))) is any(ord(c) > 127 for c in value)


def test_extract_tags(spark, rows):
    body = "x <!-- @Name: a: b --> y <!-- @Empty:--> <!-- @none --> <!-- plain: z --> <!-- @Two:\nlines --> <!-- @open: "
    df = spark.createDataFrame([(1, body), (2, "nothing"), (3, None)], "id int, body string")
    assert rows(text.extract_tags(df, "body")) == [(1, "Empty", ""), (1, "Name", "a: b"), (1, "Two", "\nlines")]


def test_predicates(spark):
    df = spark.createDataFrame(
        [(1, "HR%", None, dt.date(2024, 1, 1)), (2, "it", "x", dt.date(2024, 6, 1)), (3, None, "y", None)],
        "id int, dept string, mail string, day date",
    )

    def ids(spec):
        return sorted(r.id for r in df.where(predicate(df, spec)).collect())

    assert ids(("eq", "mail", None)) == [1]
    assert ids(("ne", "mail", None)) == [2, 3]
    assert ids(("ne", "dept", "it")) == [1]  # a null operand drops the row
    assert ids(("not", ("eq", "dept", "it"))) == [1]
    assert ids(("contains", "dept", "R%")) == [1]  # wildcards are literal
    assert ids(("contains", "dept", "_")) == []
    assert ids(("ge", "day", "2024-02-01")) == [2]
    assert ids(("or", ("startswith", "dept", "H"), ("endswith", "mail", "y"))) == [1, 3]
    assert ids(("and", ("gt", "id", 1), ("lt", "id", 3), ("le", "id", Decimal("2.5")))) == [2]
    with pytest.raises(ValueError, match="null"):
        predicate(df, ("gt", "id", None))
    with pytest.raises(ValueError, match="unknown"):
        predicate(df, ("like", "dept", "x"))


def test_guid_literal(spark):
    key = uuid.UUID("A1B2C3D4-E5F6-7890-ABCD-EF1234567890")
    df = spark.createDataFrame([(str(key),)], "id string")
    assert df.where(predicate(df, ("eq", "id", key))).count() == 1


def test_sql_types():
    assert len(TSQL_TYPES) == 33
    schema = extract_schema({"a": "NVARCHAR(20)", "b": "decimal(10, 2)", "c": "bit", "d": "unheard_of"})
    assert schema.simpleString() == "struct<a:string,b:decimal(10,2),c:boolean,d:string>"
