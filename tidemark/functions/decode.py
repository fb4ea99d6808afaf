"""Decoding of directory attribute bytes, FILETIME stamps and account flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Account-control bits by name, in bit order.
ACCOUNT_FLAGS = {
    "Script": 0x1,
    "AccountDisabled": 0x2,
    "HomeDirectoryRequired": 0x8,
    "Lockout": 0x10,
    "PasswordNotRequired": 0x20,
    "PasswordCannotChange": 0x40,
    "EncryptedTextPasswordAllowed": 0x80,
    "TempDuplicateAccount": 0x100,
    "NormalAccount": 0x200,
    "InterdomainTrustAccount": 0x800,
    "WorkstationTrustAccount": 0x1000,
    "ServerTrustAccount": 0x2000,
    "PasswordNeverExpires": 0x10000,
    "MnsLogonAccount": 0x20000,
    "SmartcardRequired": 0x40000,
    "TrustedForDelegation": 0x80000,
    "NotDelegated": 0x100000,
    "UseDesKeyOnly": 0x200000,
    "DontRequirePreauth": 0x400000,
    "PasswordExpired": 0x800000,
    "TrustedToAuthenticateForDelegation": 0x1000000,
    "PartialSecretsAccount": 0x4000000,
}

FILETIME_UNIX_EPOCH = 116_444_736_000_000_000  # 100 ns ticks from 1601-01-01 to 1970-01-01
FILETIME_MAX = 2_650_467_743_999_999_999  # last tick of the year 9999


def text(raw: Column) -> Column:
    """UTF-8 text; malformed bytes become the replacement character instead of failing the job."""
    return F.make_valid_utf8(raw.cast("string"))


def boolean(raw: Column) -> Column:
    return F.upper(text(raw)) == "TRUE"


def integer(raw: Column) -> Column:
    return F.coalesce(text(raw).try_cast("int"), F.lit(0))


def large_integer(raw: Column) -> Column:
    return F.coalesce(text(raw).try_cast("bigint"), F.lit(0).cast("bigint"))


def generalized_time(raw: Column) -> Column:
    """``yyyyMMddHHmmss...`` as UTC wall-clock time, null when it does not parse."""
    digits = F.substring(text(raw), 1, 14)
    parsed = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return F.when(digits.rlike("^[0-9]{14}$"), parsed)


def sid(raw: Column) -> Column:
    """Security identifier text ``S-1-...``; bytes that are not one come back as Base64."""
    digits = F.hex(raw)

    def number(start: Column, *offsets: int) -> Column:
        pairs = [F.substr(digits, start + F.lit(offset), F.lit(2)) for offset in offsets]
        return F.conv(F.concat(*pairs), 16, 10)

    count = F.conv(F.substring(digits, 3, 2), 16, 10).cast("int")
    authority = F.conv(F.substring(digits, 5, 12), 16, 10)
    parts = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: number(i * 8 + 17, 6, 4, 2, 0),  # little-endian 32-bit groups
    )
    well_formed = (
        (F.substring(digits, 1, 2) == "01") & (count <= 15) & (F.octet_length(raw) >= count * 4 + 8)
    )
    sid_text = F.concat_ws("-", F.lit("S"), F.lit("1"), authority, F.array_join(parts, "-"))
    return F.when(
        F.coalesce(well_formed, F.lit(False)),
        F.when(count > 0, sid_text).otherwise(F.concat_ws("-", F.lit("S"), F.lit("1"), authority)),
    ).otherwise(F.base64(raw))


def guid_from_hex(digits: Column) -> Column:
    """GUID text of 32 hex digits in storage order; the first three groups are little-endian."""
    lower = F.lower(digits)
    byte_order = [[4, 3, 2, 1], [6, 5], [8, 7], [9, 10], [11, 12, 13, 14, 15, 16]]
    groups = [F.concat(*[F.substring(lower, 2 * byte - 1, 2) for byte in group]) for group in byte_order]
    return F.concat_ws("-", *groups)


def guid(raw: Column) -> Column:
    """GUID text of 16 bytes; any other length comes back as Base64."""
    return F.when(F.octet_length(raw) == 16, guid_from_hex(F.hex(raw))).otherwise(F.base64(raw))


def filetime(ticks: Column) -> Column:
    """UTC instant of a FILETIME given as number or text; not positive, out of range or unparsable gives null."""
    value = ticks.try_cast("bigint")
    micros = F.call_function("div", value, F.lit(10).cast("bigint")) - F.lit(FILETIME_UNIX_EPOCH // 10)
    return F.when((value > 0) & (value <= FILETIME_MAX), F.timestamp_micros(micros))


def is_deleted_filetime(ticks: Column) -> Column:
    """True when a deletion FILETIME is set."""
    return F.coalesce(ticks.try_cast("bigint"), F.lit(0).cast("bigint")) > 0


def account_flags(flags: Column) -> Column:
    """Names of the set account-control bits, in bit order."""
    names = [
        F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in ACCOUNT_FLAGS.items()
    ]
    return F.array_compact(F.array(*names))
