"""Near copies by the similarity of their five-word shingles, found by bit-sliced SimHash comparison.

Texts whose sets of five-word shingles have a Jaccard similarity of ``SIMILARITY`` or more are linked; what links reach
is one class.  Texts with equal sets are compared once.

Candidates: a set has ``BANDS`` keys, each made of ``ROWS`` minimum hashes; two sets of similarity 0.8 share a key with a
probability of 0.9998.  Sets with a common key meet in a bucket and are compared there by their SimHash as bit planes.  At
similarity 0.8 fingerprints differ in 9.7 of 64 bits on average with a deviation of 2.9, so that ``RADIUS`` is 3.6
deviations away.

The rows of a bucket bring their sets along, and pairs within ``RADIUS``, nearest first, are held to the real similarity of
their sets on the spot, unless links already connect the two.  Stored sets have 32 of the 64 bits of each shingle: two
shingles of a pair of sets with n each fall together n * n / 2**32 times on average, 0.00001 times for 200 words.  So a bucket yields a spanning forest of its real links in
one pass, and no pair that shares a bucket is lost, however many of its pairs are almost similar enough.  A bucket of
more than ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles is divided into blocks, and every two blocks are compared by
themselves, so that no task holds more than two.

Defined results: null and blank texts have no shingle and are one class; a text of fewer than five words is one shingle;
repeated rows share their class; null ids get a class but never name one; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.simhash import HASH_BLOCK, SEED, bit_planes, one_of_each, within_radius
from tidemark.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
RADIUS = 20
STEPS = (8, 14, RADIUS)  # distances up to which pairs are compared before farther ones
BLOCK = 4096  # sets of a bucket that are compared with one another or with as many others
BLOCK_SHINGLES = 1 << 21  # the same in shingles
PAIRS = 1 << 14  # pairs whose sets are compared together
WORDS = 500_000  # words whose hashes a worker remembers
FLUSH = 1 << 18  # shingles in a batch

FACTOR = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(SEED)
MASKS = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
ODDS = _random.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """Hashes of words, computed at their first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * FACTOR
    values = (values ^ (values >> np.uint64(29))) * FACTOR
    return values ^ (values >> np.uint64(32))


def shingles(text: bytes | None, hashes: dict | None = None) -> np.ndarray:
    """Distinct hashes of the shingles of a UTF-8 text, ascending."""
    tokens = (text or b"").lower().split()  # of bytes: A to Z, and U+0020 with U+0009 to U+000D
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    hashes = _Hashes() if hashes is None else hashes
    words = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = out * FACTOR + words[k : k + n]
    return np.unique(mixed(out))


def digest(values: np.ndarray) -> str:
    """Name of a set of shingles."""
    return xxhash.xxh3_128_hexdigest(values.tobytes())


def simhash(values: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), HASH_BLOCK):
        block = values[at : at + HASH_BLOCK]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<i8")[0])


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band; sets with an equal one may be similar."""
    if not len(values):
        return np.empty(0, dtype=np.int64)
    least = np.array([((values ^ m) * a).min() for m, a in zip(MASKS, ODDS, strict=True)], dtype=np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = out * FACTOR + column
    return mixed(out).view(np.int64)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id``, ``fp`` (name of the set), ``n`` (shingles), ``sim``, ``bands`` and ``shingles`` of each row."""

    def lists(arrays: list[np.ndarray], kind: str = "<i8") -> pa.Array:
        offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays).view(kind)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        names = ["id", "fp", "n", "sim", "bands", "shingles"]
        for batch in batches:
            first, sets, held = 0, [], 0
            for row in range(batch.num_rows):
                sets.append(shingles(batch.column(1)[row].as_py(), hashes))
                held += len(sets[-1])
                if held >= FLUSH or row + 1 == batch.num_rows:
                    columns = [
                        batch.column(0).slice(first, len(sets)),
                        pa.array([digest(s) for s in sets]),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([simhash(s) for s in sets], pa.int64()),
                        lists([band_keys(s) for s in sets]),
                        lists([np.unique(s.view("<u4")[1::2]) for s in sets], "<i4"),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    first, sets, held = row + 1, [], 0

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        of, f"id {kind}, fp string, n bigint, sim bigint, bands array<bigint>, shingles array<int>"
    )


def buckets(nodes: DataFrame, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Columns ``key`` and ``node``; no key has many more than twice ``block`` rows or ``shingles`` shingles."""
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).filter("rows > 1")
    blocks = F.ceil(F.greatest(F.col("rows") / block, F.col("n") / shingles))
    sizes = cut_lineage(sizes.withColumn("blocks", blocks).select("key", "blocks"))
    met = keys.join(sizes, "key")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    many = met.filter("blocks > 1").select("key", "node", own.alias("own"), other.alias("other"))
    many = many.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node")
    return met.filter("blocks = 1").select("key", "node").unionByName(many)


def _tops(root: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Roots of the given places, which point to them afterwards."""
    top = root[at]
    while not np.array_equal(up := root[top], top):
        top = up
    root[at] = top
    return top


def _join(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the links joined two trees; ``root`` is brought up to date."""
    joined = np.zeros(len(left), dtype=bool)
    tops = _tops(root, left), _tops(root, right)
    for k in np.flatnonzero(tops[0] != tops[1]).tolist():
        a, b = int(tops[0][k]), int(tops[1][k])
        while root[a] != a:
            a = int(root[a])
        while root[b] != b:
            b = int(root[b])
        if a != b:
            root[max(a, b)] = min(a, b)
            joined[k] = True
    return joined


class _Sets:
    """Sets one after the other, their values as dense numbers."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = np.unique(values, return_inverse=True)[1], sizes
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.mark = np.zeros(int(self.values.max(initial=-1)) + 1, dtype=np.int32)

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of pairs of sets, sorted by ``left``; no set is empty."""
        out = np.empty(len(left), dtype=np.int64)
        firsts = np.flatnonzero(np.r_[True, left[1:] != left[:-1]]) if len(left) else []
        for first, end in zip(firsts, np.r_[firsts[1:], len(left)].astype(np.int64), strict=True):
            own = self.values[self.starts[left[first]] : self.starts[left[first] + 1]]
            self.mark[own] = 1
            for at in range(first, end, 256):  # which bounds what is held at once
                others = right[at : min(at + 256, end)]
                lengths = self.sizes[others]
                begins = np.cumsum(lengths) - lengths
                places = np.arange(int(lengths.sum())) + np.repeat(self.starts[others] - begins, lengths)
                out[at : at + len(others)] = np.add.reduceat(self.mark[self.values[places]], begins)
            self.mark[own] = 0
        return out


def similar_forest(
    keys: np.ndarray, fps: np.ndarray, sizes: np.ndarray, values: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two ends of the links of a spanning forest of all similar pairs inside buckets.

    Rows come sorted by key; ``values`` has their sets of the given sizes one after the other, none of them empty.
    """
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    rows = np.diff(np.r_[starts, n])
    left = np.repeat(starts + rows, rows) - np.arange(n)  # rows from here to the end of the bucket
    planes, sets, root = bit_planes(fps), _Sets(values, sizes), np.arange(n)
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def compare() -> None:
        a, b = (np.concatenate(ends) for ends in zip(*waiting, strict=True))
        waiting.clear()
        apart = _tops(root, a) != _tops(root, b)
        order = np.argsort(a[apart], kind="stable")
        a, b = a[apart][order], b[apart][order]
        both = sets.common(a, b)
        real = both >= similarity * (sizes[a] + sizes[b] - both) - 1e-9
        a, b = a[real], b[real]
        joined = _join(root, a, b)
        out_a.append(a[joined])
        out_b.append(b[joined])

    before = -1
    for radius in STEPS:
        tops = _tops(root, np.arange(n))
        whole = np.maximum.reduceat(tops, starts) == np.minimum.reduceat(tops, starts)
        left = np.where(np.repeat(whole, rows), 0, left)  # nothing is left to find in these buckets
        for d in range(1, int(left.max(initial=0))):
            at = within_radius(planes, left > d, d, radius)
            distance = np.bitwise_count(fps[at] ^ fps[at + d]).astype(np.int64)
            at = at[(distance <= radius) & (distance > before)]
            small, large = np.minimum(sizes[at], sizes[at + d]), np.maximum(sizes[at], sizes[at + d])
            at = at[(small >= similarity * large - 1e-9) & (root[at] != root[at + d])]
            if len(at):
                waiting.append((at, at + d))
            if sum(len(a) for a, _ in waiting) >= PAIRS:
                compare()
        if waiting:
            compare()
        before = radius
    return np.concatenate(out_a), np.concatenate(out_b)


def similar_links(nodes: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Columns ``a`` and ``b``: a spanning forest of similar sets for every bucket, whose union connects all classes.

    ``nodes`` has ``node``, ``n`` and ``bands``, ``sets`` has ``node``, ``sim`` and ``shingles``, of which none is empty.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = np.empty((4, 0), "<i8"), []  # key, node, fingerprint and size; sets

        def out(end: int) -> pa.RecordBatch:
            nonlocal held
            keys, nodes, fps, sizes = np.ascontiguousarray(held[:, :end])
            values, used = np.concatenate(parts), int(sizes.sum())
            a, b = similar_forest(keys, fps.view("<u8"), sizes, values[:used], similarity)
            held, parts[:] = held[:, end:], [values[used:]]
            pairs = np.unique(np.sort(np.stack([nodes[a], nodes[b]], axis=1), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            lists = batch.column(3)
            plain = [c.to_numpy() for c in batch.columns[:3]]
            held = np.concatenate([held, np.stack([*plain, lists.value_lengths().to_numpy()])], axis=1)
            parts.append(lists.flatten().to_numpy())
            if sum(map(len, parts)) >= FLUSH:
                whole = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0  # the last bucket may go on
                if whole and int(held[3, :whole].sum()) >= FLUSH:
                    yield out(whole)
        if held.shape[1]:
            yield out(held.shape[1])

    met = cut_lineage(buckets(nodes, block))
    rows = met.join(sets, "node").select("key", "node", "sim", "shingles")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work grows faster than the bytes
    ordered = rows.repartition(tasks, "key").sortWithinPartitions("key", "sim", "node")
    return ordered.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK
) -> DataFrame:
    """Columns ``id``, ``fp`` (name of the set), ``root`` (the class) and ``component_id`` (its smallest id), row by row."""
    rows = cut_lineage(signatures(df, id_col, text_col).withColumn("node", F.monotonically_increasing_id()))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first"), F.min("node").alias("node")))
    nodes = rows.filter("n > 0").select("node", "n", "bands").join(distinct.select("node"), "node", "left_semi")
    links = similar_links(nodes, rows.select("node", "sim", "shingles"), similarity, block)
    roots = cut_lineage(connected_components(links).withColumnRenamed("root", "top"))
    placed = cut_lineage(distinct.join(roots, "node", "left").select("fp", "first", F.coalesce("top", "node").alias("root")))
    names = cut_lineage(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    placed = cut_lineage(placed.join(names, "root").select("fp", "root", "component_id"))
    return rows.select("id", "fp").join(placed, "fp").select("id", "fp", "root", "component_id")


def one_copy_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each class one, with the smallest id; see ``one_of_each`` for unclear ids."""
    near = near_copies(df, id_col, text_col)
    return one_of_each(df, id_col, text_col, near, lambda text: digest(shingles(text)), "string")
