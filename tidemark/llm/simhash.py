"""Near-duplicates by SimHash, compared over bit planes.

A text's fingerprint has bit k set if bit k is set in over half of the hashes of its three-word shingles.  Texts
whose fingerprints differ in at most ``RADIUS`` bits are linked; what links reach is one class.

Candidates: fingerprints within ``RADIUS`` bits agree on one of ``RADIUS + 1`` bands, and on the bits outside that band
they agree on one of ``RADIUS + 1`` smaller bands again.  Two such levels make the buckets; buckets with more than
``BUCKET`` fingerprints are divided by further levels until none is left, so no pair is lost and no task holds more.

Comparison: a task keeps the fingerprints of its buckets as 64 bit planes, one lane per fingerprint.  At offset d it
compares every fingerprint with the d-th one after it: planes are xored with planes shifted by d lanes, carry-save
counters add the differing bits of 64 lanes at a time, and a word of lanes is abandoned once every lane has exceeded the
radius.  A bucket yields a spanning forest of its links, not its pairs.

Defined results: a null or blank text has fingerprint zero and is linked like any other; repeated rows share class and
fingerprint; null ids get a class but never name one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.session import cut_lineage

SEED = 42
SHINGLE = 3
RADIUS = 3
BITS = 64
BUCKET = 1024  # fingerprints of one bucket that a task compares
HASH_BLOCK = 1 << 16  # shingles hashed before their bits are added up, which bounds the memory of a long text


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number."""
    tokens = (text or b"").lower().split()  # of bytes: A to Z, and U+0020 with U+0009 to U+000D
    if not tokens:
        return 0
    n, counts = max(1, len(tokens) - SHINGLE + 1), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, HASH_BLOCK):
        block = tokens[at : at + HASH_BLOCK + SHINGLE - 1]
        shingles = zip(*(block[k:] for k in range(SHINGLE)), strict=False) if len(block) >= SHINGLE else [tuple(block)]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id`` and ``fp``, a row for each row of ``df``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        of, f"id {kind}, fp bigint"
    )


def refine(rows: DataFrame, bits: int, bands: int) -> tuple[DataFrame, int]:
    """Divide buckets (``key``, ``rest`` with ``bits`` bits, ``fp``) by each of ``bands`` bands of the rest.

    Keys are hashes; two buckets that share one by accident cost comparisons and change no result.
    """
    width = -(-bits // bands)

    def band(k: int) -> Column:
        low, size = k * width, max(0, min(width, bits - k * width))
        rest = F.col("rest")
        value = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << size) - 1)) if size else F.lit(0)
        above = F.shiftleft(F.shiftrightunsigned(rest, low + size), low) if low + size < BITS else F.lit(0)
        below = rest.bitwiseAND(F.lit((1 << low) - 1))
        return F.struct(
            F.xxhash64("key", F.lit(k), value.cast("bigint")).alias("key"),
            above.cast("bigint").bitwiseOR(below.cast("bigint")).alias("rest"),
        )

    parts = F.explode(F.array(*(band(k) for k in range(bands)))).alias("p")
    return rows.select("fp", parts).select("p.key", "p.rest", "fp"), bits - width


def buckets(distinct: DataFrame, radius: int, limit: int) -> DataFrame:
    """Columns ``key`` and ``fp``: every pair within the radius shares a key, and no key has over ``limit`` rows."""
    rows = distinct.select(F.lit(0).cast("bigint").alias("key"), F.col("fp").alias("rest"), "fp")
    rows, bits = refine(rows, BITS, radius + 1)
    rows, bits = refine(rows, bits, radius + 1)
    done = []
    while True:
        hot = cut_lineage(rows.groupBy("key").count().filter(F.col("count") > limit).select("key"))
        if hot.isEmpty() or bits <= 0:
            done.append(rows)
            break
        done.append(rows.join(hot, "key", "left_anti"))
        rows, bits = refine(rows.join(hot, "key", "left_semi"), bits, radius + 1)
        rows = cut_lineage(rows)
    out = done[0].select("key", "fp")
    for more in done[1:]:
        out = out.unionByName(more.select("key", "fp"))
    return out


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Words of lanes by bit: plane k holds bit k of every value, 64 values to the word."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((BITS, -(-len(values) // 64) * 64), dtype=np.uint8)
    lanes[:, : len(values)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def shifted(planes: np.ndarray, lanes: int, words: np.ndarray) -> np.ndarray:
    """Given words of the planes that hold, in lane i, what the planes hold in lane i + ``lanes``."""
    word, bit = divmod(lanes, 64)
    low = planes[:, np.minimum(words + word, planes.shape[1] - 1)] >> np.uint64(bit)
    if not bit:
        return low
    return low | planes[:, np.minimum(words + word + 1, planes.shape[1] - 1)] << np.uint64(64 - bit)


def within_radius(planes: np.ndarray, same: np.ndarray, lanes: int, radius: int) -> np.ndarray:
    """Rows that share their bucket with the row ``lanes`` further on and differ from it in at most ``radius`` bits."""
    mask = np.zeros(planes.shape[1] * 64, dtype=bool)
    mask[: len(same)] = same
    valid = np.packbits(mask, bitorder="little").view("<u8")
    words = np.flatnonzero(valid)
    valid = valid[words]
    differ = planes[:, words] ^ shifted(planes, lanes, words)
    n_counters = max(1, radius.bit_length())
    counters, over = [np.zeros(len(words), dtype=np.uint64) for _ in range(n_counters)], ~valid
    for k in range(0, BITS, 2):
        x, y, ones = differ[k], differ[k + 1], counters[0]
        half = ones ^ x
        carry = (ones & x) | (half & y)
        counters[0] = half ^ y
        for j in range(1, n_counters):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over = over | carry
        if k % 16 == 14 and not (alive := ~over != 0).all():  # abandon the words in which every lane is beyond
            words, over, differ = words[alive], over[alive], differ[:, alive]
            counters = [c[alive] for c in counters]
            if not len(words):
                break
    lanes_left = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(lanes_left)
    return words[word] * 64 + lane


def forest(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside buckets; rows come sorted by key."""
    n, root = len(keys), np.arange(len(keys))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows from here to the end of the bucket
    wide = np.repeat(sizes > 1, sizes)
    keys, fps, left = keys[wide], fps[wide], left[wide]
    root = np.arange(len(fps))
    planes = bit_planes(fps) if len(fps) else None
    for d in range(1, int(left.max(initial=0))):
        at = within_radius(planes, left > d, d, radius)
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= radius]
        at = at[root[at] != root[at + d]]
        for i in at.tolist():
            a, b = i, i + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(at):
            while not np.array_equal(up := root[root], root):
                root = up
    linked = np.flatnonzero(root != np.arange(len(root)))
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """Columns ``a`` and ``b``: a spanning forest for every bucket of fingerprints, whose union connects all classes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = forest(keys, fps.view("<u8"), radius)
            pairs = np.unique(np.stack([a.view("<i8"), b.view("<i8")], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        keys, fps = np.empty(0, "<i8"), np.empty(0, "<i8")
        for batch in batches:
            keys, fps = np.r_[keys, batch.column(0).to_numpy()], np.r_[fps, batch.column(1).to_numpy()]
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if whole >= HASH_BLOCK:
                yield out(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield out(keys, fps)

    sorted_rows = buckets(distinct, radius, limit).repartition("key").sortWithinPartitions("key", "fp")
    return sorted_rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, limit: int = BUCKET
) -> DataFrame:
    """Columns ``id``, ``fp``, ``root`` (a fingerprint, the class) and ``component_id`` (its smallest id), row by row."""
    rows = cut_lineage(fingerprints(df, id_col, text_col))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = cut_lineage(connected_components(links(distinct, radius, limit)))
    placed = cut_lineage(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        )
    )
    names = cut_lineage(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    placed = cut_lineage(placed.join(names, "root").select("fp", "root", "component_id"))
    return rows.join(placed, "fp").select("id", "fp", "root", "component_id")


def one_of_each(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    near: DataFrame | None = None,
    print_of: Callable[[bytes | None], int | str] = fingerprint,
    print_type: str = "bigint",
) -> DataFrame:
    """The rows of ``df`` that stay: of each class one, with the smallest id.

    Where the id of such a row is null or repeated, its fingerprint decides, and of equal rows one stays.  Other classes
    can be given as ``near``, with the columns of ``near_duplicates``, together with the function that gives its ``fp``.
    """
    near = cut_lineage(near_duplicates(df, id_col, text_col) if near is None else near)
    first = near.filter(F.col("id").eqNullSafe(F.col("component_id")))
    leaders = cut_lineage(first.groupBy("root").agg(F.max("id").alias("id"), F.min("fp").alias("fp")))
    repeated = cut_lineage(near.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"))
    unclear = near.filter("id is null").limit(1).count() + repeated.limit(1).count() > 0
    known = leaders.filter("id is not null")
    if not unclear:
        return df.join(known.select(F.col("id").alias(id_col)), id_col, "left_semi").select(df.columns)
    known = known.join(repeated, "id", "left_anti")
    sure = df.join(known.select(F.col("id").alias(id_col)), id_col, "left_semi").select(df.columns)
    rest = df.filter(F.col(id_col).isNull()).unionByName(
        df.join(repeated.withColumnRenamed("id", id_col), id_col, "left_semi").select(df.columns)
    )
    wanted = leaders.join(repeated.withColumn("again", F.lit(True)), "id", "left").filter("id is null or again")
    marked = rest.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = marked.schema["row"].dataType.simpleString()
    id_kind = df.schema[id_col].dataType.simpleString()

    def with_fp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([print_of(value.as_py()) for value in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["row", "id", "fp"])

    keyed = marked.mapInArrow(with_fp, f"row {kind}, id {id_kind}, fp {print_type}").alias("k")
    same = F.col("k.id").eqNullSafe(F.col("w.id")) & (F.col("k.fp") == F.col("w.fp"))
    matched = keyed.join(wanted.select("id", "fp").alias("w"), same).select("k.*")
    return sure.unionByName(matched.dropDuplicates(["id", "fp"]).select("row.*"))
