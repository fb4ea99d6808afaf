"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Texts are encoded and cut into pieces of at most ``CAPACITY`` tokens; a full piece is a sequence by itself.  All other
pieces are dealt at random into shards of about ``SHARD`` pieces, and several islands evolve packings of each shard.  An
individual is a list of bins.  Crossover injects whole well-filled bins of one parent into the other, removes the bins
that hold one of their documents a second time, and best-fits the displaced documents; a mutation dissolves the emptiest
bins.  Between epochs the elite of each island, its best packing's well-filled bins, migrates to the next island, where
it is injected.  The best packing of a shard counts.  Its bins without a gap are sequences; the pieces of all others are
dealt anew into fewer shards, down to a single one.  Where sizes hardly ever fill a bin, so that most bins have a gap,
only the emptiest quarter of a shard's bins is dealt anew: what one shard could not pair meets what others could not.

No task holds more than the pieces of a shard, whatever the table's size.  Everything random has a fixed seed.

Defined results: a null or empty text is a document with the end id alone; rows with equal ids are documents of their
own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
import random
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.tokens import CHUNK_CHARS, encoder
from tidemark.session import cut_lineage

CAPACITY = 2048
SHARD = 4096  # pieces that an island packs
ISLANDS = 2  # islands for each shard
EPOCHS = 2
POPULATION = 4
GENERATIONS = 8
ELITE = 0.98  # bins filled to this share are well filled

Bins = list[list[int]]


def pieces(df: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``: the pieces of every document."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    schema = StructType(
        [
            StructField("doc_id", rows.schema["doc_id"].dataType),
            StructField("piece", IntegerType()),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids_crc32", LongType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, arrow, end = encoder(tokenizer).encode, to_arrow_schema(schema), np.array([end_id], dtype="<u4")

        def out(keys: list, texts: list[str]) -> pa.RecordBatch:
            ids, ends = encode(texts)
            found, begin = [], 0
            for key, stop in zip(keys, ends.tolist(), strict=True):
                own, begin = np.r_[ids[begin:stop], end].astype("<u4"), stop
                for n, at in enumerate(range(0, len(own), CAPACITY)):
                    part = own[at : at + CAPACITY]
                    found.append((key, n, at, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= CHUNK_CHARS or len(texts) >= 10_000:
                    yield out(keys, texts)
                    keys, texts, size = [], [], 0
        if texts:
            yield out(keys, texts)

    return rows.mapInArrow(cut, schema)


@dataclass
class Packing:
    """Bins of items with their fills.  Bins are never changed in place, so that packings can share them."""

    bins: Bins
    fills: list[int]

    def worth(self, capacity: int) -> tuple[int, int]:
        """Fewer bins first, then uneven fills: gaps that meet in few bins can be filled later."""
        return -len(self.bins), sum(f * f for f in self.fills)


def best_fit(items: list[int], sizes: list[int], start: Packing, capacity: int) -> Packing:
    """Put each item, in the given order, into the bin that it fills best, or into a new one."""
    bins, fills = list(start.bins), list(start.fills)
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin has r tokens of room
    for b, fill in enumerate(fills):
        open_bins.setdefault(capacity - fill, []).append(b)
        rooms |= 1 << (capacity - fill)
    for i in items:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            same = open_bins[room]
            b = same.pop()
            if not same:
                rooms ^= 1 << room
            bins[b] = [*bins[b], i]
            fills[b] += size
        else:
            room, b = capacity, len(bins)
            bins.append([i])
            fills.append(size)
        room -= size
        same = open_bins.setdefault(room, [])
        same.append(b)
        rooms |= 1 << room
    return Packing(bins, fills)


def without(packing: Packing, items: set[int], given: Packing) -> tuple[Packing, list[int]]:
    """``given`` followed by the bins of ``packing`` that hold none of ``items``, and the displaced rest."""
    bins, fills, displaced = list(given.bins), list(given.fills), []
    for members, fill in zip(packing.bins, packing.fills, strict=True):
        if items.isdisjoint(members):
            bins.append(members)
            fills.append(fill)
        else:
            displaced += [i for i in members if i not in items]
    return Packing(bins, fills), displaced


def evolve(sizes: list[int], capacity: int, seed: int, individuals: list[Packing]) -> Packing:
    """The best packing that crossover and mutation reach from ``individuals`` and from best-fit packings."""
    chance = random.Random(seed)
    items = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    least = -(-sum(sizes) // capacity)

    def crossed(giver: Packing, taker: Packing) -> Packing:
        """Inject well-filled bins of one parent, drop what repeats their items, best-fit the displaced."""
        well = [b for b, f in enumerate(giver.fills) if f >= ELITE * capacity and chance.random() < 0.5]
        given = Packing([giver.bins[b] for b in well], [giver.fills[b] for b in well])
        kept, displaced = without(taker, {i for members in given.bins for i in members}, given)
        return best_fit(sorted(displaced, key=lambda i: -sizes[i]), sizes, kept, capacity)

    def mutated(packing: Packing) -> Packing:
        order = sorted(range(len(packing.bins)), key=lambda b: packing.fills[b])
        gone = set(order[: 2 + len(order) // 20]) | {chance.randrange(len(order)) for _ in range(2)}
        loose = [i for b in gone for i in packing.bins[b]]
        chance.shuffle(loose)
        stay = [b for b in range(len(packing.bins)) if b not in gone]
        kept = Packing([packing.bins[b] for b in stay], [packing.fills[b] for b in stay])
        return best_fit(loose, sizes, kept, capacity)

    def rank(packing: Packing) -> tuple[tuple[int, int], int, Packing]:
        return packing.worth(capacity), -next(ticket), packing

    ticket = itertools.count()
    population = [rank(p) for p in individuals] or [rank(best_fit(items, sizes, Packing([], []), capacity))]
    for _ in range(GENERATIONS):
        population.sort(reverse=True)
        del population[POPULATION:]
        if -population[0][0][0] <= least:
            break
        if len(population) < POPULATION:  # a packing by sizes that are off by up to a fifth for each one before
            noise = 0.2 * len(population)
            order = sorted(items, key=lambda i: -sizes[i] * (1 + noise * chance.random()))
            population.append(rank(best_fit(order, sizes, Packing([], []), capacity)))
        giver, taker = chance.sample(population, 2)
        children = crossed(giver[2], taker[2]), crossed(taker[2], giver[2]), mutated(population[0][2])
        population += [rank(child) for child in children]
    return max(population)[2]


PLACED = "shard bigint, island int, pid bigint, length bigint, bin bigint, offset bigint, fill bigint"


def island(capacity: int, epoch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One epoch of one island: rows of its own packing (``own``) and of a neighbour's elite become its best packing."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, name = int(rows["shard"].iloc[0]), int(rows["island"].iloc[0])
        own = rows[rows["own"]].sort_values("pid")
        pids, sizes = own["pid"].to_numpy(), own["length"].astype(int).tolist()

        def packing(part: pd.DataFrame) -> Packing:
            at = np.searchsorted(pids, part["pid"].to_numpy())
            bins = [list(g) for g in pd.Series(at).groupby(part["bin"].to_numpy()).apply(list)]
            return Packing(bins, [sum(sizes[i] for i in members) for members in bins])

        individuals = []
        if epoch:
            mine, elite = packing(own), packing(rows[~rows["own"]])
            kept, loose = without(mine, {i for members in elite.bins for i in members}, elite)
            loose.sort(key=lambda i: -sizes[i])
            individuals = [mine, best_fit(loose, sizes, kept, capacity)]
        best = evolve(sizes, capacity, (shard * ISLANDS + name) * EPOCHS + epoch, individuals)
        found = []
        for b, (members, fill) in enumerate(zip(best.bins, best.fills, strict=True)):
            at = 0
            for i in members:
                found.append((shard, name, pids[i], sizes[i], b, at, fill))
                at += sizes[i]
        return pd.DataFrame(found, columns=["shard", "island", "pid", "length", "bin", "offset", "fill"])

    return run


def evolved(items: DataFrame, n_shards: int, capacity: int) -> DataFrame:
    """The best packing of each shard of ``items`` (``pid``, ``length``), with columns as in ``PLACED``."""
    each = F.explode(F.array(*(F.lit(k) for k in range(ISLANDS)))).alias("island")
    rows = items.select("pid", "length", F.pmod(F.xxhash64("pid"), F.lit(n_shards)).alias("shard"), each)
    state = rows.select("*", F.lit(0).cast("bigint").alias("bin"), F.lit(True).alias("own"))
    for epoch in range(EPOCHS):
        placed = cut_lineage(state.groupBy("shard", "island").applyInPandas(island(capacity, epoch), PLACED))
        migrants = placed.filter(F.col("fill") >= ELITE * capacity).withColumn("island", (F.col("island") + 1) % ISLANDS)
        state = placed.withColumn("own", F.lit(True)).unionByName(migrants.withColumn("own", F.lit(False)))
    worth = placed.groupBy("shard", "island").agg(F.max("bin").alias("bins"))
    chosen = worth.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("best"))
    chosen = cut_lineage(chosen.select("shard", F.col("best.island").alias("island")))
    return placed.join(chosen, ["shard", "island"])


def emptiest(placed: DataFrame, share: float = 0.25) -> DataFrame:
    """The bins (``shard``, ``bin``) of each shard that are filled least; a shard has at most as many as pieces."""
    bins = placed.groupBy("shard", "bin").agg(F.first("fill").alias("fill"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("fill", "bin"))
    total = F.count("*").over(Window.partitionBy("shard"))
    least = bins.select("shard", "bin", place.alias("place"), total.alias("total"))
    return least.filter(F.col("place") <= F.ceil(F.col("total") * share)).select("shard", "bin", F.lit(True).alias("emptiest"))


def most_pieces(placed: DataFrame, shard: int, bins: int = 64) -> DataFrame:
    """Up to ``bins`` bins with the most pieces, together at most half a shard."""
    counted = placed.groupBy("shard", "bin").agg(F.count("*").alias("pieces")).filter(F.col("pieces") <= shard // (2 * bins))
    chosen = counted.orderBy(F.desc("pieces"), "shard", "bin").limit(bins)
    return chosen.select("shard", "bin", F.lit(True).alias("helps"))


def packed(parts: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; ``parts`` has pieces with a ``length`` up to the capacity."""
    parts = cut_lineage(parts.withColumn("pid", F.monotonically_increasing_id()))
    full = F.col("length") >= capacity
    done = [parts.filter(full).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    items, level = parts.filter(~full).select("pid", "length"), 0
    n = items.count()
    while n:
        n_shards = -(-n // shard)
        placed = cut_lineage(evolved(items, n_shards, capacity))
        name = (F.lit(level) * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
        if n_shards == 1:
            done.append(placed.select("pid", name, "offset"))
            break
        gaps = F.col("fill") < capacity
        left = placed.filter(gaps).count()
        if 4 * left > 3 * n:  # dealing all of them anew would not bring the rest together
            placed = cut_lineage(placed.join(emptiest(placed.filter(gaps)), ["shard", "bin"], "left"))
            gaps = F.col("emptiest").isNotNull()
            left = placed.filter(gaps).count()
        if 0 < left <= shard // 2:  # the last shard has room: bins of many pieces help it to close its gaps
            placed = cut_lineage(placed.join(most_pieces(placed.filter(~gaps), shard), ["shard", "bin"], "left"))
            gaps = gaps | F.col("helps").isNotNull()
            left = placed.filter(gaps).count()
        done.append(placed.filter(~gaps).select("pid", name, "offset"))
        items, n, level = placed.filter(gaps).select("pid", "length"), left, level + 1
    sequences = done[0]
    for more in done[1:]:
        sequences = sequences.unionByName(more)
    return parts.join(sequences, "pid").drop("pid")
