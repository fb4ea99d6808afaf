"""Token-id files in directly addressable codes.

An id is split into chunks, the lowest first: 12 bits, then 4 bits at a time.  Level 1 holds the first chunk of every
token; its bitmap says which tokens go on, and level 2 holds the next chunk of those alone, and so on.  A rank directory
counts the set bits before every block of 512 bits, so token i of level 1 is token rank(i) of level 2.  A token is read
from one chunk, one bit, one directory entry and at most 512 bits for each level; nothing is decoded around it.

A segment is a byte string that holds whole documents in ascending order: header, document ends, then the levels.
Segments are stored through Spark as rows with a binary column, beside the first and last document, the position of the
segment among all tokens and a checksum; so writing is committed, retried and spread like any other table, on any store
that Spark can write.

Defined results: a null or empty text has the end id alone; rows with equal ids follow one another and are documents of
their own; null ids come first; an empty table makes no segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from tidemark.llm.tokens import CHUNK_CHARS, encoder

MAGIC = b"TDAC1\0\0\0"
WIDTHS = (12, 4)  # bits of the first chunk and of every further one
RANK_BLOCK = 512  # bits between two entries of a rank directory
SEGMENT_TOKENS = 1 << 18  # a segment is closed by the document that reaches this


def pack_chunks(values: np.ndarray, width: int) -> bytes:
    """Values of 4 or 12 bits, two of them to 1 or 3 bytes."""
    v = values.astype(np.uint32)
    if len(v) % 2:
        v = np.r_[v, np.zeros(1, np.uint32)]
    pair = v[0::2] | v[1::2] << np.uint32(width)
    out = pair.astype("<u4").view(np.uint8).reshape(-1, 4)
    return out[:, : width // 4].tobytes()


def unpack_chunks(data: np.ndarray, count: int, width: int) -> np.ndarray:
    pairs = np.zeros((len(data) // (width // 4), 4), dtype=np.uint8)
    pairs[:, : width // 4] = data.reshape(-1, width // 4)
    pair = pairs.view("<u4")[:, 0]
    values = np.empty(2 * len(pair), dtype=np.uint32)
    values[0::2], values[1::2] = pair & ((1 << width) - 1), pair >> width
    return values[:count]


def encode_segment(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """Bytes of a segment with the given ids and document ends."""
    levels, rest, width = [], ids.astype(np.uint32), WIDTHS[0]
    while True:
        more = rest >> np.uint32(width) != 0
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.int64) if len(more) else []
        ranks = (np.cumsum(blocks) - blocks).astype("<u4") if len(more) else np.empty(0, "<u4")
        chunk = pack_chunks(rest & np.uint32((1 << width) - 1), width)
        levels.append((len(rest), width, chunk, bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> np.uint32(width)
        if not len(rest):
            break
        width = WIDTHS[1]
    head = struct.pack("<8sIIQQ", MAGIC, len(levels), 0, len(ids), len(ends))
    table = b"".join(struct.pack("<QIIII", n, w, len(c), len(b), len(r)) for n, w, c, b, r in levels)
    return b"".join([head, table, ends.astype("<u8").tobytes(), *(part for level in levels for part in level[2:])])


class Segment:
    """A segment read in place."""

    def __init__(self, data: bytes) -> None:
        magic, n_levels, _, self.n_tokens, n_docs = struct.unpack_from("<8sIIQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize("<8sIIQQ")
        shapes = [struct.unpack_from("<QIIII", data, at + 24 * k) for k in range(n_levels)]
        at += 24 * n_levels
        self.ends = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self.levels = []
        for n, width, *sizes in shapes:
            parts = []
            for size in sizes:
                parts.append(np.frombuffer(data, np.uint8, size, at))
                at += size
            self.levels.append((n, width, parts[0], parts[1], parts[2].view("<u4")))

    def token(self, i: int) -> int:
        """Token ``i``, from one chunk for each of its levels."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for _, width, chunks, bits, ranks in self.levels:
            pair = int.from_bytes(chunks[i // 2 * (width // 4) :][: width // 4].tobytes(), "little")
            value |= (pair >> width * (i % 2) & (1 << width) - 1) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            block = i // RANK_BLOCK
            before = np.unpackbits(bits[block * RANK_BLOCK // 8 : i // 8 + 1], bitorder="little")
            i = int(ranks[block]) + int(before[: i % RANK_BLOCK].sum())
            shift += width
        return value

    def tokens(self) -> np.ndarray:
        """All tokens, level by level."""
        value = np.zeros(self.n_tokens, dtype=np.uint32)
        at, shift = np.arange(self.n_tokens), 0
        for n, width, chunks, bits, _ in self.levels:
            value[at] |= unpack_chunks(chunks, n, width) << np.uint32(shift)
            at, shift = at[np.unpackbits(bits, count=n, bitorder="little").astype(bool)], shift + width
        return value


def write_token_files(
    df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write all texts in ascending order of their ids to segments below ``path``.

    Range partitioning spreads the order over tasks.  A task knows where its segments begin within its partition;
    ``partition`` and ``position`` are stored with them, and readers add the totals of the partitions before.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    id_type = rows.schema["id"].dataType
    schema = StructType(
        [
            StructField("partition", IntegerType()),
            StructField("position", LongType()),  # tokens of the partition before this segment
            StructField("n_tokens", LongType()),
            StructField("crc32", LongType()),
            StructField("ids", ArrayType(id_type)),  # the documents of the segment
            StructField("data", BinaryType()),
        ]
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, arrow, partition = encoder(tokenizer).encode, to_arrow_schema(schema), TaskContext.get().partitionId()
        position, keys, parts, ends = 0, [], [], []  # of the open segment

        def closed() -> pa.RecordBatch:
            nonlocal position, keys, parts, ends
            data = encode_segment(np.concatenate(parts), np.array(ends))
            row = [partition, position, ends[-1], zlib.crc32(data), keys, data]
            position, keys, parts, ends = position + ends[-1], [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        def added(names: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            flat, stops = encode(texts)
            begin = 0
            for name, stop in zip(names, stops.tolist(), strict=True):
                keys.append(name)
                parts.append(np.r_[flat[begin:stop], np.uint32(end_id)])
                ends.append((ends[-1] if ends else 0) + stop - begin + 1)
                begin = stop
                if ends[-1] >= SEGMENT_TOKENS:
                    yield closed()

        names, texts, size = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(name.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= CHUNK_CHARS or len(texts) >= 10_000:
                    yield from added(names, texts)
                    names, texts, size = [], [], 0
        if texts:
            yield from added(names, texts)
        if keys:
            yield closed()

    ordered = rows.repartitionByRange(F.col("id").asc()).sortWithinPartitions("id")
    ordered.mapInArrow(write, schema).write.option("compression", "none").parquet(path)


def with_starts(segments: DataFrame) -> DataFrame:
    """``segments`` with ``start``, the tokens of all segments before.

    One row for each partition that was written, whatever the number of tokens, is summed in one place and broadcast.
    """
    totals = segments.groupBy("partition").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("partition", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    joined = segments.join(F.broadcast(offsets), "partition")
    return joined.withColumn("start", F.col("before") + F.col("position"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, decoded from the files."""
    segments = with_starts(spark.read.parquet(path))
    id_type = segments.schema["ids"].dataType.elementType
    schema = StructType(
        [
            StructField("id", id_type),
            StructField("start", LongType()),
            StructField("n_tokens", LongType()),
            StructField("ids_crc32", LongType()),
        ]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for ids, start, crc, data in zip(*batch.columns, strict=True):
                data, start = data.as_py(), start.as_py()
                if zlib.crc32(data) != crc.as_py():
                    raise ValueError("a token segment is damaged")
                segment = Segment(data)
                tokens, begins = segment.tokens().astype("<u4"), np.r_[0, segment.ends[:-1]]
                sums = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(begins, segment.ends, strict=True)]
                columns = [ids.values, start + begins, segment.ends - begins, sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return segments.select("ids", "start", "crc32", "data").mapInArrow(decode, schema)


def read_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """``places`` (``at``: positions among all tokens) with ``token``, by random access; others have no row.

    Distinct places are gathered by segment, at most as many as it has tokens, so that each segment is opened once.
    """
    segments = with_starts(spark.read.parquet(path)).select("start", "n_tokens", "data")
    first = F.floor(F.col("start") / SEGMENT_TOKENS)
    last = F.floor((F.col("start") + F.col("n_tokens") - 1) / SEGMENT_TOKENS)
    cells = segments.select("start", "n_tokens", F.explode(F.sequence(first, last)).alias("cell"))
    asked = places.select("at").distinct().withColumn("cell", F.floor(F.col("at") / SEGMENT_TOKENS))
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n_tokens"))
    by_segment = asked.join(cells, "cell").filter(inside).groupBy("start").agg(F.collect_list("at").alias("ats"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ats, data in zip(*batch.columns, strict=True):
                segment, at = Segment(data.as_py()), ats.as_py()
                values = [segment.token(a - start.as_py()) for a in at]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values, pa.int64())], ["at", "token"])

    read = segments.join(by_segment, "start").select("start", "ats", "data").mapInArrow(look, "at bigint, token bigint")
    return places.join(read, "at")
