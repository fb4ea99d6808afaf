"""Tables in parts: versions that share files, so that a batch rewrites only the files whose keys it holds.

A row belongs to the part that the hash of its key gives.  Below the table's folder lie

* ``data/<write>/_part=<n>/``: files of rows, sorted by key; a part of a large table is written by several tasks, whose
  files overlap;
* ``blooms/<write>/_part=<n>/``: for each file a blocked Bloom filter of its keys, one row per 64-bit word;
* ``versions/<n>/``: ``files`` (the manifest: one row per file with its rows, lowest and highest key and a digest of its
  rows), ``tree`` (digests over parts, see :mod:`tidemark.operators.snapshot_tree`) and ``about``.

A batch goes to the files whose bounds and Bloom filter may hold one of its keys (``touched_files``).  These are read,
changed by any keyed operator and written anew; all other files are in the next version by name.  Versions appear by one
rename that fails where the number is taken, so a reader sees a whole version, of two writers one is refused, and a batch
that runs again finds its own version and changes nothing.

The driver holds names of files: at most one for each file of the table, in a small batch one for each that it touches.

Defined results: a row without a key, or a key that occurs twice, fails the job (``rejected_rows`` sorts both out
before); keys of a batch that the table lacks get files of their own in their parts; an empty batch makes a version with
the files of the one before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.keys import has_key, require_unique
from tidemark.operators.merge import comparable
from tidemark.operators.snapshot_tree import tree_of
from tidemark.session import cut_lineage

PART = "_part"
SLICE = "_slice"
SLICES = 4  # tasks that write a part of a large table, each a file or more of it
FILE_ROWS = 5_000_000  # rows of a file; what a task has more of a part goes to several, which its sorted keys divide
KEY_BITS = 10  # bits of a Bloom filter for each key
WORD = 64
PROBES = 4  # bits of a key, all in one word


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


@dataclass(frozen=True)
class PartTable:
    """One version of a table.  ``by``: the columns among ``keys`` whose hash gives a row's part."""

    spark: SparkSession
    path: str
    version: int
    keys: tuple[str, ...]
    by: tuple[str, ...]
    parts: int
    schema: T.StructType

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions/{self.version}/files")

    @property
    def tree(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions/{self.version}/tree")

    def files(self, parts: Sequence[int] | None = None) -> list[str]:
        """Names of all files, or of those of some parts."""
        files = self.manifest
        if parts is not None:
            files = files.join(_numbers(self.spark, parts), PART, "left_semi")
        return [r.file for r in files.select("file").collect()]

    def read(self, files: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of some files; no other file is opened."""
        files = self.files() if files is None else files
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in files])

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows whose ``by`` columns are those of a row of ``wanted``; files of other parts are not opened."""
        wanted = cut_lineage(_typed(wanted, self.by, self.schema).where(has_key(self.by)).distinct())
        return self._in_parts_of(wanted).join(wanted, list(self.by), "left_semi")

    def present(self, wanted: DataFrame) -> DataFrame:
        """The ``by`` columns of ``wanted`` that some row has, once; files of other parts are not opened."""
        wanted = cut_lineage(_typed(wanted, self.by, self.schema).where(has_key(self.by)).distinct())
        return wanted.join(self._in_parts_of(wanted).select(*self.by).distinct(), list(self.by), "left_semi")

    def _in_parts_of(self, wanted: DataFrame) -> DataFrame:
        return self.read(self.files([r[0] for r in wanted.select(part_of(self.by, self.parts)).distinct().collect()]))


def _numbers(spark: SparkSession, parts: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in parts], f"{PART} int")


def _typed(df: DataFrame, columns: Sequence[str], schema: T.StructType) -> DataFrame:
    """Columns in the types of a table, as hashes differ between types."""
    return df.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns])


def part_of(by: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int").alias(PART)


def _complete(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` unchanged; the job fails at a row without a key."""
    message = F.concat(F.lit("a row has no key: "), F.to_json(F.struct(*rows.columns)))
    return rows.where(F.when(has_key(keys), True).otherwise(F.raise_error(message).cast("boolean")))


def hashable(schema: T.StructType) -> list[Column]:
    """All columns in a form whose hash tells nulls, and values of nested types, apart."""
    out = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType | T.StructType | T.MapType | T.VariantType):
            value = F.to_json(F.struct(comparable(value, field.dataType).alias("v")))
        out += [value, value.isNull()]
    return out


def _probe(keys: Sequence[str], words: Column) -> list[Column]:
    """The word of a file's Bloom filter that a key belongs to, and the bits that it sets there."""
    word = F.pmod(F.xxhash64(*keys, F.lit("word")), words).alias("word")
    spread_bits = F.xxhash64(*keys, F.lit("bits"))
    one = F.lit(1).cast("bigint")
    bits = [
        F.call_function("shiftleft", one, F.shiftrightunsigned(spread_bits, 6 * k).bitwiseAND(F.lit(WORD - 1)).cast("int"))
        for k in range(PROBES)
    ]
    return [word, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("mask")]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all committed versions."""
    files, folder = _fs(spark, f"{path}/versions")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder)) if files.exists(folder) else []


def _about(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{version}/about", wholetext=True).first()[0])


def _batches(spark: SparkSession, path: str, known: Sequence[int]) -> set[str]:
    """Ids of the batches of all versions."""
    folders = [f"{path}/versions/{v}/about" for v in known]
    return {json.loads(r.value)["batch"] for r in spark.read.text(folders, wholetext=True).collect()}


def open_table(spark: SparkSession, path: str, version: int | None = None) -> PartTable:
    """The latest version of a table, or a given one."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version {version if version is not None else ''}".rstrip())
    version = known[-1] if version is None else version
    about = _about(spark, path, version)
    schema = T.StructType.fromJson(about["schema"])
    return PartTable(spark, path, version, tuple(about["keys"]), tuple(about["by"]), about["parts"], schema)


def create(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    parts: int,
    by: Sequence[str] | None = None,
    file_rows: int = FILE_ROWS,
) -> PartTable:
    """Write ``df`` as version 0 of a new table.  ``parts`` decides what the smallest read is, and never changes."""
    table = PartTable(df.sparkSession, path, -1, tuple(keys), tuple(by or keys), parts, df.schema.toNullable())
    return _commit(table, _written(table, df, file_rows, check=True), None, "")


def _written(table: PartTable, rows: DataFrame, file_rows: int, check: bool = False) -> DataFrame:
    """Write rows and the Bloom filters of their files; the entries of the manifest, read back from the files.

    With ``check`` a key that occurs twice fails the job, by the sort that the files need anyway.
    """
    spark, write, keys = table.spark, uuid.uuid4().hex, table.keys
    slices = F.pmod(F.xxhash64(*keys, F.lit("slice")), F.lit(SLICES))
    placed = _complete(rows, keys).withColumn(PART, part_of(table.by, table.parts)).withColumn(SLICE, slices)
    dealt = placed.repartition(F.col(PART), F.col(SLICE))
    if check:
        dealt = require_unique(dealt, keys, [PART, *keys, SLICE])
    dealt = dealt.sortWithinPartitions(PART, *keys).drop(SLICE)
    dealt.write.option("maxRecordsPerFile", file_rows).partitionBy(PART).parquet(f"{table.path}/data/{write}")
    stored = spark.read.schema(T.StructType([*table.schema.fields, T.StructField(PART, T.IntegerType())]))
    # A task's files in several parts share a name.
    stored = stored.parquet(f"{table.path}/data/{write}")
    stored = stored.withColumn("_name", F.col("_metadata.file_name")).withColumn("_row", F.col("_metadata.row_index"))
    row = hashable(table.schema)
    counted = cut_lineage(
        stored.groupBy(PART, "_name").agg(
            F.count("*").alias("_rows"),
            *(F.bit_xor(F.xxhash64(F.lit(side), *row)).alias(side) for side in ("digest1", "digest2")),
        )
        .withColumn("_words", F.greatest(F.lit(1), F.ceil(F.col("_rows") * KEY_BITS / WORD)))
        .withColumn("_file", F.monotonically_increasing_id())
    )
    # Files are sorted by key, so the first and the last row have the bounds.
    key = F.struct(*keys)
    ends = stored.select(*keys, PART, "_name", "_row").join(F.broadcast(counted.select(PART, "_name", "_rows")), [PART, "_name"])
    ends = ends.where((F.col("_row") == 0) | (F.col("_row") == F.col("_rows") - 1))
    bounds = ends.groupBy(PART, "_name").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    file = F.concat(F.lit(f"{write}/{PART}="), F.col(PART).cast("string"), F.lit("/"), F.col("_name")).alias("file")
    entries = counted.join(bounds, [PART, "_name"]).withColumnsRenamed({"_rows": "rows", "_words": "words"})
    entries = cut_lineage(entries.select(PART, file, "rows", "low", "high", "digest1", "digest2", "words"))
    numbers = F.broadcast(counted.select(PART, "_name", "_words", "_file"))
    with_words = stored.select(*keys, PART, "_name").join(numbers, [PART, "_name"])
    filters = with_words.select("_file", *_probe(keys, F.col("_words")))
    filters = filters.groupBy("_file", "word").agg(F.bit_or("mask").alias("bits"))
    filters = filters.join(numbers, "_file").select(PART, file, "word", "bits")
    filters = filters.repartition(F.col(PART)).sortWithinPartitions(PART, "file", "word")
    filters.write.partitionBy(PART).parquet(f"{table.path}/blooms/{write}")
    return entries


def _commit(table: PartTable, entries: DataFrame, replaced: list[str] | None, batch: str) -> PartTable:
    """The next version: all files of this one but the replaced, and the new ones."""
    spark, following = table.spark, table.version + 1
    if table.version >= 0:
        gone = spark.createDataFrame([(f,) for f in replaced or []], "file string")
        entries = table.manifest.join(gone, "file", "left_anti").unionByName(entries)
    staged = f"{table.path}/staged/{uuid.uuid4().hex}"
    entries.coalesce(1).write.parquet(f"{staged}/files")
    files = spark.read.parquet(f"{staged}/files")
    tree_of(files, table.parts).coalesce(1).write.parquet(f"{staged}/tree")
    about = {"keys": table.keys, "by": table.by, "parts": table.parts, "schema": table.schema.jsonValue(), "batch": batch}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{staged}/about")
    _rename(spark, staged, f"{table.path}/versions", str(following))
    return open_table(spark, table.path, following)


def _rename(spark: SparkSession, source: str, folder: str, name: str) -> None:
    """Move a folder to a name that nobody has taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files, parent = _fs(spark, folder)
    files.mkdirs(parent)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), target, options)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException" or files.exists(target):
            raise Conflict(f"version {name} was committed by another writer; run the batch again") from None
        raise


def touched_files(table: PartTable, batch: DataFrame) -> list[str]:
    """Files that may hold a key of ``batch``: by part, by bounds, then by Bloom filter."""
    spark = table.spark
    keyed = _typed(batch, table.keys, table.schema).where(has_key(table.keys)).distinct()
    wanted = keyed.withColumn(PART, part_of(table.by, table.parts))
    files = table.manifest.select(PART, "file", "low", "high", "words")
    key = F.struct(*table.keys)
    near = wanted.join(files, PART).where((key >= F.col("low")) & (key <= F.col("high")))
    near = cut_lineage(near.select("file", *_probe(table.keys, F.col("words"))))
    names = [r.file for r in near.select("file").distinct().collect()]
    if not names:
        return []
    folders = sorted({f"{table.path}/blooms/{name.rsplit('/', 1)[0]}" for name in names})
    filters = spark.read.schema("file string, word bigint, bits bigint").parquet(*folders)
    maybe = near.join(filters, ["file", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return [r.file for r in maybe.select("file").distinct().collect()]


def apply_batch(
    table: PartTable,
    batch: DataFrame,
    change: Callable[[DataFrame, DataFrame], DataFrame],
    batch_id: str,
    file_rows: int = FILE_ROWS,
) -> PartTable:
    """The next version, in which ``change`` of the rows of the touched files and of the batch replaces these files.

    ``change`` is any operator that leaves rows alone whose key the batch does not hold, for instance ``merge_upsert``,
    ``delete_by_key`` or ``soft_delete`` with their keys.  A ``batch_id`` that a version already carries is not applied
    again; the latest version, which holds its rows, is returned.
    """
    if not batch_id:
        raise ValueError("a batch needs an id, by which a repeated run finds what it has done")
    known = versions(table.spark, table.path)
    if batch_id in _batches(table.spark, table.path, known):
        return open_table(table.spark, table.path)
    if known[-1] > table.version:
        raise Conflict(f"version {known[-1]} was committed by another writer; open the table anew")
    batch = cut_lineage(batch)
    files = touched_files(table, batch)
    rows = change(table.read(files), batch).select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])
    return _commit(table, _written(table, rows, file_rows), files, batch_id)


def compacted(table: PartTable, batch_id: str, most: int = 4, file_rows: int = FILE_ROWS) -> PartTable:
    """The next version, in which parts with over ``most`` files are written anew."""
    crowded = table.manifest.groupBy(PART).count().where(F.col("count") > most)
    files = [r.file for r in table.manifest.join(crowded, PART, "left_semi").select("file").collect()]
    if not files:
        return table
    return _commit(table, _written(table, table.read(files), file_rows), files, batch_id)


def has_batch(table: PartTable, batch_id: str) -> bool:
    """Whether a version of the table carries the batch."""
    return batch_id in _batches(table.spark, table.path, versions(table.spark, table.path))
