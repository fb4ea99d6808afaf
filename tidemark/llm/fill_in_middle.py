"""Fill-in-middle transformation of whole texts by displacement scatter, and its inverse by gather.

A text is a sequence of units, ``[A-Za-z]+|[^A-Za-z]`` over its code points.  Two cuts between units divide it into
prefix, middle and suffix, which are written in another order with a mark before each of them::

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text as it is

All texts of an Arrow batch are one array of bytes.  A scan of it finds the units and so the cuts.  A part of a text
keeps its bytes in order and moves as a whole, so a difference array holds, at the first byte of each part, by how much
the shift of its bytes differs from that of the part before; its cumulative sum is the shift of every byte, and one
scatter writes all outputs.  The inverse looks the marks up in the output, builds the shifts from the output's side and
gathers the bytes of the texts.

The form and the cuts of a text follow from a hash of its id alone, so they never depend on partitions or on other rows,
and a task that runs again makes the same rows.

Defined results: a null text is an empty one; an empty text is plain, and so is a text that holds one of the marks, as
its output could not be read back; a null id counts as an empty one in the hash; rows with equal ids are cut alike, each
by its own length; an empty table gives no rows; other columns are ignored.  A task holds ``CHUNK_BYTES`` of texts at a
time, or one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

CHUNK_BYTES = 4_000_000  # bytes of texts that are moved together
PLAIN_PERCENT = 10  # texts that stay as they are
SPM_PERCENT = 20  # of the others, those with the suffix first
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
WIDTH = 3  # bytes of a mark


@dataclass
class Texts:
    """Texts of a batch one after the other: their bytes, and where each of them begins and ends."""

    data: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """The texts of an Arrow column without nulls, in place."""
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        kind = np.int64 if wide else np.int32
        starts = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        return cls(flat[starts[0] : starts[-1]], starts - starts[0])

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def column(self) -> pa.Array:
        if self.starts[-1] < 2**31:
            return pa.StringArray.from_buffers(
                len(self.starts) - 1, pa.py_buffer(self.starts.astype(np.int32)), pa.py_buffer(self.data)
            )
        return pa.LargeStringArray.from_buffers(len(self.starts) - 1, pa.py_buffer(self.starts), pa.py_buffer(self.data))


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with at most ``size`` bytes each, or with one text."""
    starts = Texts.of(column).starts
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + size, "right")) - 1)
        yield at, end
        at = end


def marks_in(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every mark within a text: the number of the text, the place of the mark, and the letter that it holds."""
    data = texts.data
    if len(data) < WIDTH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    at = at[np.isin(data[at + 1], [m[1] for m in MARKS.values()])]
    text = np.searchsorted(texts.starts, at, "right") - 1
    inside = at + WIDTH <= texts.starts[text + 1]
    at, text = at[inside], text[inside]
    return text, at, data[at + 1]


def shifts(size: int, begins: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    """Shift of every byte, where each text has parts that begin at ``begins`` and move by ``moves``, in order."""
    begin, move = np.stack(begins, axis=1).ravel(), np.stack(moves, axis=1).ravel()
    difference = np.zeros(size + 1, np.int64)
    np.add.at(difference, begin, np.diff(move, prepend=0))  # parts without bytes add up at one place
    return np.cumsum(difference[:-1])


def part_places(form: np.ndarray, begin: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> list:
    """Where prefix, middle and suffix lie in outputs that begin at ``begin``, from the numbers of their bytes."""
    psm, spm = form == PSM, form == SPM
    first = begin + np.where(form == PLAIN, 0, WIDTH)
    return [
        np.where(spm, first + suffix + WIDTH, first),
        np.select([psm, spm], [first + prefix + suffix + 2 * WIDTH] * 2, first + prefix),
        np.select([psm, spm], [first + prefix + WIDTH, first], first + prefix + middle),
    ]


def rearranged(texts: Texts, form: np.ndarray, cut1: np.ndarray, cut2: np.ndarray) -> Texts:
    """Outputs of all texts, which are cut at the bytes ``cut1`` and ``cut2``."""
    starts, ends = texts.starts[:-1], texts.starts[1:]
    out = np.r_[0, np.cumsum(texts.sizes + np.where(form == PLAIN, 0, 3 * WIDTH))]
    places = part_places(form, out[:-1], cut1 - starts, cut2 - cut1, ends - cut2)
    begins = [starts, cut1, cut2]
    shift = shifts(len(texts.data), begins, [p - b for p, b in zip(places, begins, strict=True)])
    data = np.empty(out[-1], np.uint8)
    data[np.arange(len(shift)) + shift] = texts.data
    moved = form != PLAIN
    for place, name in zip(places, ("prefix", "middle", "suffix"), strict=True):
        at = place[moved][:, None] - WIDTH + np.arange(WIDTH)
        data[at] = np.frombuffer(MARKS[name], np.uint8)
    return Texts(data, out)


def restored(outputs: Texts, form: np.ndarray) -> Texts:
    """The texts from which outputs of the given forms were made."""
    text, at, letter = marks_in(outputs)
    moved = form != PLAIN
    begin = {}
    for name, mark in MARKS.items():
        mine = (letter == mark[1]) & moved[text]
        if not np.array_equal(text[mine], np.flatnonzero(moved)):
            raise ValueError(f"an output that is not plain does not hold {mark.decode()} exactly once")
        begin[name] = outputs.starts[:-1].copy()
        begin[name][moved] = at[mine] + WIDTH
    ends, spm = outputs.starts[1:], form == SPM
    prefix = np.where(moved, np.where(spm, begin["middle"], begin["suffix"]) - WIDTH - begin["prefix"], 0)
    suffix = np.where(moved, np.where(spm, begin["prefix"], begin["middle"]) - WIDTH - begin["suffix"], outputs.sizes)
    middle = np.where(moved, ends - begin["middle"], 0)
    if min((x.min() for x in (prefix, middle, suffix) if len(x)), default=0) < 0:
        raise ValueError("the marks of an output are not in the order of its form")
    starts = np.r_[0, np.cumsum(prefix + middle + suffix)]
    begins = [starts[:-1], starts[:-1] + prefix, starts[:-1] + prefix + middle]
    moves = [begin[n] - b for n, b in zip(("prefix", "middle", "suffix"), begins, strict=True)]
    shift = shifts(starts[-1], begins, moves)
    return Texts(outputs.data[np.arange(len(shift)) + shift], starts)


def transformed(texts: Texts, h: list[np.ndarray], plain_percent: int, spm_percent: int) -> tuple[np.ndarray, ...]:
    """Units, form, code points of prefix and of middle, and output of every text."""
    data, starts, ends = texts.data, texts.starts[:-1], texts.starts[1:]
    letter = ((data | 0x20) - np.uint8(ord("a"))) < 26
    lead = (data & 0xC0) != 0x80  # first bytes of code points
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[starts[starts < ends]] = False
    units = np.r_[np.flatnonzero(lead & ~goes_on), len(data)]
    before = np.searchsorted(units, texts.starts)  # units before each text
    n = np.diff(before)
    k1, k2 = h[0] % (n + 1), h[1] % (n + 1)
    k1, k2 = np.minimum(k1, k2), np.maximum(k1, k2)
    # The unit after a text's last one begins where the text ends, also where empty texts follow.
    cut1, cut2 = (np.where(k < n, units[np.minimum(before[:-1] + k, len(units) - 1)], ends) for k in (k1, k2))
    marked = np.zeros(len(n), bool)
    marked[marks_in(texts)[0]] = True
    plain = (n == 0) | marked | (h[2] % 100 >= 100 - plain_percent)
    form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm_percent, SPM, PSM))
    cut1, cut2 = np.where(plain, starts, cut1), np.where(plain, starts, cut2)
    points = np.r_[0, np.cumsum(lead)]
    chars = points[cut1] - points[starts], points[cut2] - points[cut1]
    return n, form, *chars, rearranged(texts, form, cut1, cut2)


def draws(id_: Column, seed: int, count: int = 4) -> list[Column]:
    """Numbers from 0 to 2**32 - 1 for an id: the 8-digit groups of the hex SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(count)]


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """Columns ``id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    drawn = [h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), seed))]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *drawn)
    fields = [("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType())]
    schema = StructType([rows.schema["id"], *(StructField(*f) for f in [*fields, ("output", StringType())])])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for at, end in slices(whole.column(1), CHUNK_BYTES):
                batch = whole.slice(at, end - at)
                h = [batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)]
                n, form, prefix, middle, out = transformed(Texts.of(batch.column(1)), h, plain_percent, spm_percent)
                plain = form == PLAIN
                columns = [
                    batch.column(0),
                    pa.array(n),
                    pa.array(np.array(FORMS, object)[form], pa.string()),
                    pa.array(prefix, mask=plain),
                    pa.array(middle, mask=plain),
                    out.column(),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(make, schema)


def restore(made: DataFrame, text_col: str = "text") -> DataFrame:
    """``made`` (columns ``form`` and ``output`` among its columns) with the exact text, from these two alone."""
    others = [c for c in made.columns if c not in ("form", "output", text_col)]
    rows = made.select("form", "output", *others)
    schema = StructType([*rows.schema.fields, StructField(text_col, StringType())])

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for whole in batches:
            for at, end in slices(whole.column(1), CHUNK_BYTES):
                batch = whole.slice(at, end - at)
                names = np.array(batch.column(0).to_pylist(), object)
                form = np.select([names == f for f in FORMS], range(len(FORMS)), -1)
                if (form < 0).any():
                    raise ValueError(f"unknown form {names[form < 0][0]!r}")
                texts = restored(Texts.of(batch.column(1)), form).column()
                yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(arrow.field(text_col).type)], schema=arrow)

    return rows.mapInArrow(undo, schema)
