"""SentencePiece ids of whole texts by a table of distinct marked words, and the texts of ids.

The library turns the spaces of a text into marks, with one more mark in front, and merges characters to pieces.  Where
no piece of the model has a mark behind another character, no merge reaches over the start of a run of marks.  Then the
pieces of a text are those of its marked words (a run of marks and what follows it up to the next one) in order.  Each
distinct marked word of a batch is looked up in the worker's table; words that it lacks are segmented by the library
once, and the ids of all words are joined back by position.

Whether this holds is read from the model itself (``splits_at_marks``): byte-pair pieces, text that is not normalised,
a mark in front, no mark behind another character in any piece.  With any other model whole texts go to the library.

Ids are kept as bytes, little-endian unsigned 32-bit integers, as files of token ids hold them.

Defined results: a null text is an empty one; an empty text has the begin and end ids alone and decodes to an empty
text; rows with equal ids, and null ids, are rows of their own; an empty table gives no rows; other columns are ignored.
A worker remembers at most ``2 * WORDS`` marked words of up to ``WORD_CHARS`` characters; all others are segmented anew.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
WORDS = 200_000
WORD_CHARS = 100
CHUNK_CHARS = 1_000_000  # characters of texts whose marked words are looked up together
CHUNK_IDS = 1_000_000  # ids of texts that are decoded together
MARKED_WORD = re.compile(" +[^ ]*")


def splits_at_marks(model: sentencepiece_model_pb2.ModelProto) -> bool:
    """Whether marked words can be segmented one by one with the result of the whole text."""
    rules, trainer = model.normalizer_spec, model.trainer_spec
    return (
        trainer.model_type == trainer.BPE
        and not rules.precompiled_charsmap
        and rules.add_dummy_prefix
        and rules.escape_whitespaces
        and not rules.remove_extra_whitespaces
        and not trainer.treat_whitespace_as_suffix
        and not any(MARK in p.piece.lstrip(MARK) or " " in p.piece for p in model.pieces)
        and any(p.piece == MARK for p in model.pieces)
    )


class Pieces:
    """Ids of texts by one model, with a table of the marked words that this worker has met."""

    def __init__(self, path: str, words: int = WORDS) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.by_word, self.limit = splits_at_marks(model), words
        self.begin, self.end = (self._bytes([i]) for i in (self.library.bos_id(), self.library.eos_id()))
        # The library puts no mark in front of an empty text, so the word of one mark has no text that gives it.
        self.alone = self._bytes([self.library.piece_to_id(MARK)])
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _segmented(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(ids) for ids in self.library.encode(texts, num_threads=1)]

    def _ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct marked words: from the table, or by the library."""
        if len(self.table) > self.limit:
            self.older, self.table = self.table, {}
        found = {}
        for word in words & self.older.keys() - self.table.keys():
            self.table[word] = self.older[word]
        new = [w for w in words if w not in self.table]
        for word, ids in zip(new, self._segmented([w[1:] for w in new]), strict=True):
            ids = ids if word != " " else self.alone
            if len(word) <= WORD_CHARS:
                self.table[word] = ids
            else:
                found[word] = ids
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, begin and end ids included."""
        if not self.by_word:
            return [self.begin + ids + self.end for ids in self._segmented(texts)]
        marked = [MARKED_WORD.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        long = self._ids_of(set().union(*marked))
        known = self.table.__getitem__ if not long else lambda w: long[w] if w in long else self.table[w]
        return [self.begin + b"".join(map(known, words)) + self.end for words in marked]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1) if ids else []


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The worker's table for a model file, kept between tasks."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes reach ``limit`` with their last row alone."""
    at = total = 0
    for k, size in enumerate(sizes):
        total += size
        if total >= limit or k + 1 == len(sizes):
            yield at, k + 1
            at, total = k + 1, 0


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id``, ``n_tokens`` and ``ids`` (bytes) of every row, begin and end ids included."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    schema = StructType([rows.schema["id"], StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, arrow = pieces_of(model), to_arrow_schema(schema)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for at, end in runs(sizes, CHUNK_CHARS):
                part = batch.slice(at, end - at)
                ids = pieces.encode(part.column(1).to_pylist())
                columns = [part.column(0), pa.array([len(i) // 4 for i in ids]), pa.array(ids)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(segment, schema)


def decode(encoded: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``encoded`` (column ``ids`` among its columns) with the text that the library decodes from the ids."""
    rows = encoded.select("ids", *[c for c in encoded.columns if c not in ("ids", text_col)])
    schema = StructType([*rows.schema.fields, StructField(text_col, StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, arrow = pieces_of(model), to_arrow_schema(schema)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(0)).to_pylist()
            for at, end in runs(sizes, 4 * CHUNK_IDS):
                part = batch.slice(at, end - at)
                texts = pa.array(pieces.decode(part.column(0).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(arrow.field(text_col).type)], schema=arrow)

    return rows.mapInArrow(join, schema)
