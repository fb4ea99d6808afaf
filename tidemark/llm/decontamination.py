"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-case letters and digits with single spaces between.  An item of n characters that occurs in
a document with at most e edits shares at least n + 1 - q - q e of its q-grams with it, on diagonals (document position
minus item position) that lie within e of each other.  So every shared q-gram is counted in the two overlapping bands of
2 e + 2 diagonals that hold its diagonal; a band that reaches the bound names a region, and a banded alignment of the
whole item with that region decides.  Bands and alignments belong to one text: what stands before and after it in a task
has no part in them, so results do not depend on how rows are dealt out.

e is a tenth of an item's characters.  q is 8, or less where an item is so short that it need not share any q-gram of 8
with an occurrence; items of under 8 characters must occur as they are, as whole words.

Places and items that share q-grams are counted ``HITS`` at a time, so memory is bounded whatever items have in common.
Time follows the text and these pairs: a phrase in many items costs each of them a look at each of its places.

The benchmark is the stated query set: it is taken in blocks of bounded size, and each block is held against every
document where that document lies, without a shuffle.

Defined results: a null or blank document has no matches; items without letters or digits are not looked for; equal
items are each reported; repeated documents are each reported; empty tables give an
empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

Q = 8
EDIT_RATE = 0.1  # edits that an item may show, as a share of its characters
BLOCK_CHARS = 4_000_000  # characters of the benchmark that one pass over the documents looks for
CHUNK_CHARS = 1_000_000  # characters of documents that a task looks at together
ALIGNMENTS = 256  # regions that are aligned together
HITS = 2_000_000  # places of q-grams in texts times items that have them, which are counted together
BASE = np.uint32(0x9E3779B1)
SPACE = 32


def _kept() -> np.ndarray:
    """Which code points below U+10000 are part of words; all others become spaces.  Those above are kept."""
    return np.array([unicodedata.category(chr(c))[0] in "LNM" for c in range(0x10000)])


KEPT = _kept()


def lower(text: str) -> str:
    """Lower case, character by character where the whole text would change its length."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, each text followed by a zero; where each was in the originals; text starts."""
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64)) - 1
    chars = np.frombuffer("\0".join([*map(lower, texts), ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = KEPT[np.minimum(chars, 0xFFFF)] | (chars > 0xFFFF)
    keep = word.copy()
    keep[1:] |= word[:-1]  # of a run of other characters the first stands for all
    folded = np.where(word, chars, np.uint32(SPACE))
    folded[ends] = 0
    keep[ends] = True
    at = np.flatnonzero(keep)
    return folded[at], at, np.r_[0, ends[:-1] + 1]


def gram_codes(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each position on, by doubling."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    code, have, power = None, 0, chars.astype(np.uint32)
    width = 1
    while True:
        if q & width:
            factor = np.uint32(pow(int(BASE), width, 1 << 32))
            code = power[: len(chars)] if code is None else code[: len(power) - have] * factor + power[have:]
            have += width
        if width * 2 > q:
            return code[:n]
        power = power[:-width] * np.uint32(pow(int(BASE), width, 1 << 32)) + power[width:]
        width *= 2


def gram_length(n: int, edits: int, q: int = Q) -> int:
    """The longest q-grams, of up to ``q`` characters, of which an item with its edits must still share one."""
    return min(q, n // (edits + 1))


class Items:
    """Items of one block with q-grams of one length: folded characters, edit budgets, bounds, index of the q-grams.

    ``whole``: items that only count as whole words.
    """

    def __init__(self, ids: list, chars: list[np.ndarray], edits: list[int], q: int, whole: bool) -> None:
        self.q, self.ids, self.chars, self.whole = q, ids, chars, whole
        n = np.array([len(c) for c in chars], dtype=np.int64)
        self.edits = np.array(edits, dtype=np.int64)
        self.bounds = n + 1 - q - q * self.edits
        grams = [gram_codes(c, q) for c in chars]
        code = np.concatenate(grams)
        order = np.argsort(code, kind="stable")  # of one q-gram the items ascend
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.pos = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.entry = np.repeat(np.arange(len(self.codes)), self.count) * len(ids) + self.item
        self.bits = max(16, int(len(code)).bit_length() + 5)
        self.bits = min(self.bits, 28)
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self.codes >> np.uint32(32 - self.bits)] = True


def indexed(ids: list, texts: list[str], q: int = Q, edit_rate: float = EDIT_RATE) -> list[Items]:
    """The items of a block by the length of their q-grams; blank items are left out."""
    groups: dict[tuple[int, bool], tuple[list, list, list]] = {}
    for name, text in zip(ids, texts, strict=True):
        chars = strip(fold([text])[0][:-1])
        if len(chars):
            edits = int(len(chars) * edit_rate) if len(chars) >= q else 0
            members = groups.setdefault((gram_length(len(chars), edits, q), len(chars) < q), ([], [], []))
            for values, value in zip(members, (name, chars, edits), strict=True):
                values.append(value)
    return [Items(*members, length, whole) for (length, whole), members in sorted(groups.items(), key=lambda g: g[0])]


def strip(chars: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(chars != SPACE)
    return chars[words[0] : words[-1] + 1] if len(words) else chars[:0]


def aligned(
    patterns: list[np.ndarray],
    text: np.ndarray,
    origin: np.ndarray,
    begin: np.ndarray,
    end: np.ndarray,
    width: int,
    anchored: bool,
    budget: np.ndarray,
    step: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignments of whole patterns with parts of ``text``: least edits, and the diagonal on which each ends.

    Alignment c computes ``width`` diagonals, all alignments a row at a time.  Its diagonal 0 pairs the first character
    of the pattern with ``text[origin[c]]``; ``step`` -1 reads the text to the left.  Anchored ones begin at the
    origin, which lies in the middle of the band; others begin on any diagonal.  What lies outside
    ``text[begin[c]:end[c]]`` equals no character.  The least cost of a row never falls, so an alignment whose costs all
    exceed its ``budget`` is given up.
    """
    rows, lengths = max(map(len, patterns)), np.array([len(p) for p in patterns])
    table = np.zeros((rows, len(patterns)), dtype=np.uint32)
    for c, pattern in enumerate(patterns):
        table[: len(pattern), c] = pattern
    diagonals = np.arange(width, dtype=np.int32)
    offset = diagonals - width // 2 if anchored else diagonals
    places = origin[:, None] + step * offset
    low, high, last = begin[:, None], end[:, None], len(text) - 1
    far = np.int32(1 << 20)
    start = np.where(offset >= 0, offset, far) if anchored else np.zeros(width, dtype=np.int32)
    cost = np.repeat(start[None, :].astype(np.int32), len(patterns), axis=0)
    edits, ends = np.full(len(patterns), far, dtype=np.int64), np.zeros(len(patterns), dtype=np.int64)
    live = np.arange(len(patterns))
    for j in range(rows):
        if j and j % 8 == 0:
            keep = (cost.min(axis=1) <= budget[live]) & (lengths[live] > j)
            if not keep.all():
                live, cost, places, low, high = live[keep], cost[keep], places[keep], low[keep], high[keep]
                table = table[:, keep]
            if not len(live):
                break
        at = places + step * j
        other = (text[np.clip(at, 0, last)] != table[j][:, None]) | (at < low) | (at >= high)
        changed = cost + other
        np.minimum(changed[:, :-1], cost[:, 1:] + 1, out=changed[:, :-1])
        cost = np.minimum.accumulate(changed - diagonals, axis=1) + diagonals
        for c in np.flatnonzero(lengths[live] == j + 1):
            best = int(np.argmin(cost[c]))
            edits[live[c]], ends[live[c]] = cost[c, best], offset[best]
    return edits, ends


def expanded(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``first[k]``, ``first[k] + 1``, ... with ``times[k]`` numbers for each k."""
    return np.repeat(first - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())


def slices(weights: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs whose weights sum to ``limit`` at most, or of single ones that weigh more."""
    total, at = np.cumsum(weights), 0
    while at < len(weights):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield at, end
        at = end


def regions(chars: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, ...]]:
    """Item, text, and lowest and highest diagonal, of the bands of a text that share enough q-grams with an item.

    Where many items share a q-gram, all pairs of a place and an item would not fit.  Items are taken in groups with
    at most ``HITS`` pairs, an item with more alone and over slices of the places, of which only the counts stay.
    """
    codes = gram_codes(chars, items.q)
    at = np.flatnonzero(items.seen[codes >> np.uint32(32 - items.bits)])
    place = np.searchsorted(items.codes, codes[at])
    found = place < len(items.codes)
    found[found] = items.codes[place[found]] == codes[at[found]]
    at, place = at[found], place[found]
    if not len(at):
        return
    text = np.searchsorted(starts, at, side="right") - 1
    n, longest = len(items.ids), max(map(len, items.chars))
    known, uses = np.unique(place, return_counts=True)
    members = items.item[expanded(items.first[known], items.count[known])]
    pairs = np.bincount(members, weights=np.repeat(uses, items.count[known]), minlength=n).astype(np.int64)
    n_bands = len(chars) + 2 * longest + 3
    for low_item, high_item in slices(pairs, HITS):
        if not pairs[low_item:high_item].any():
            continue
        first = np.searchsorted(items.entry, place * n + low_item)
        times = np.searchsorted(items.entry, place * n + high_item) - first
        parts = []
        for a, b in slices(times, HITS):
            entry = expanded(first[a:b], times[a:b])
            item, many = items.item[entry], times[a:b]
            diagonal = np.repeat(at[a:b], many) - items.pos[entry]
            band = (diagonal + longest) // (items.edits[item] + 1)
            parts.append(np.unique((item * len(starts) + np.repeat(text[a:b], many)) * n_bands + band + 1, return_counts=True))
        names, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        before = np.r_[False, names[1:] == names[:-1] + 1]  # is the step below there as well?
        shared = counts + np.where(before, np.r_[0, counts[:-1]], 0)
        owner = names // n_bands
        full = shared >= items.bounds[owner // len(starts)]
        which, step = owner[full] // len(starts), items.edits[owner[full] // len(starts)] + 1
        low = (names[full] % n_bands - 2) * step - longest
        yield which, owner[full] % len(starts), low, low + 2 * step - 1


def matches(chars: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """Text, item, first and last position plus one, and edits, of every occurrence; of overlapping ones the best.

    Every alignment sees the one text that its q-grams lie in.
    """
    stops_of = np.r_[starts[1:], len(chars)] - 1  # each text is followed by a zero
    lengths = np.array([len(c) for c in items.chars])
    for near in regions(chars, starts, items):
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        order = np.lexsort((near[2], near[1], near[0], lengths[near[0]]))
        near = [values[order] for values in near]
        for at in range(0, len(order), ALIGNMENTS):  # alike in length, so that they share rows and width
            which, text, low, high = (values[at : at + ALIGNMENTS] for values in near)
            budget, size = items.edits[which], lengths[which]
            begin, end = starts[text], stops_of[text]
            width = int((high - low + 2 * budget).max()) + 1
            patterns = [items.chars[k] for k in which]
            edits, ends = aligned(patterns, chars, low - budget, begin, end, width, False, budget)
            stops = low - budget + ends + size
            sure = np.flatnonzero((edits <= budget) & (stops > begin))
            if not len(sure):
                continue
            patterns = [patterns[c][::-1] for c in sure]
            width = 2 * int(budget.max()) + 1
            _, back = aligned(patterns, chars, stops[sure] - 1, begin[sure], end[sure], width, True, budget[sure], -1)
            for c, shift in zip(sure.tolist(), back.tolist(), strict=True):
                start = max(int(begin[c]), int(stops[c] - size[c] - shift))
                stop = min(int(end[c]), int(stops[c]))
                if start < stop and (not items.whole or is_word(chars, start, stop, int(begin[c]), int(end[c]))):
                    found.setdefault((int(text[c]), int(which[c])), []).append((int(edits[c]), start, stop))
        for (text, item), spans in found.items():
            taken: list[tuple[int, int]] = []  # in order of their places
            for edits, start, stop in sorted(set(spans)):
                k = bisect.bisect_left(taken, (start, stop))
                if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= stop):
                    taken.insert(k, (start, stop))
                    yield text, item, start, stop, edits


def is_word(chars: np.ndarray, start: int, stop: int, begin: int, end: int) -> bool:
    return (start == begin or chars[start - 1] == SPACE) and (stop == end or chars[stop] == SPACE)


def occurrences(texts: list[str], blocks_of_items: list[Items]) -> Iterator[tuple[int, object, int, int, int]]:
    """Text, id of the item, start and end in the text's code points, and edits."""
    folded, at, originals = fold(texts)
    starts = np.r_[0, np.flatnonzero(folded == 0)[:-1] + 1]
    for items in blocks_of_items:
        for row, k, start, stop, edits in matches(folded, starts, items):
            yield row, items.ids[k], int(at[start] - originals[row]), int(at[stop - 1] + 1 - originals[row]), edits


def blocks(bench: DataFrame, block_chars: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the benchmark (``item_id``, ``t``), a block of about ``block_chars`` characters at a time."""
    size = bench.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = int(size // block_chars) + 1
    for block in range(n):
        rows = bench.filter(F.pmod(F.xxhash64("t", "item_id"), F.lit(n)) == block).collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def items_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return benchmark.select(F.col(item_col).alias("item_id"), text.alias("t"))


def chunks(texts: Iterator[tuple[object, str]], chars: int) -> Iterator[list[tuple[object, str]]]:
    """Texts with their keys, together until they have ``chars`` characters."""
    part, size = [], 0
    for key, text in texts:
        part.append((key, text))
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    edit_rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Columns ``item_id``, ``doc_id``, ``start``, ``end`` (code points) and ``edits``: a row for each occurrence."""
    bench = items_of(benchmark, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    schema = StructType(
        [
            StructField("item_id", bench.schema["item_id"].dataType),
            StructField("doc_id", rows.schema["doc_id"].dataType),
            StructField("start", LongType()),
            StructField("end", LongType()),
            StructField("edits", IntegerType()),
        ]
    )
    found = None
    for ids, item_texts in blocks(bench, block_chars):

        def scan(
            batches: Iterator[pa.RecordBatch], ids: list = ids, item_texts: list[str] = item_texts
        ) -> Iterator[pa.RecordBatch]:
            items, arrow = indexed(ids, item_texts, q, edit_rate), to_arrow_schema(schema)
            texts = (
                (key.as_py(), text.as_py())
                for batch in batches
                for key, text in zip(batch.column(0), batch.column(1), strict=True)
                if items and text.as_py()
            )
            for part in chunks(texts, CHUNK_CHARS):
                hits = [(k, part[r][0], a, b, e) for r, k, a, b, e in occurrences([t for _, t in part], items)]
                columns = list(zip(*hits, strict=True)) or [()] * len(arrow)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

        one = rows.mapInArrow(scan, schema)
        found = one if found is None else found.unionByName(one)
    return found


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    edit_rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` in which no item occurs; one pass for each block of the benchmark."""
    for ids, item_texts in blocks(items_of(benchmark, item_col, item_text_col), block_chars):

        def clean(
            batches: Iterator[pa.RecordBatch], ids: list = ids, item_texts: list[str] = item_texts
        ) -> Iterator[pa.RecordBatch]:
            items = indexed(ids, item_texts, q, edit_rate)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                column = batch.column(batch.schema.names.index(text_col))
                texts = ((k, t.as_py()) for k, t in enumerate(column) if items and t.as_py())
                for part in chunks(texts, CHUNK_CHARS):
                    keep[[part[r][0] for r, *_ in occurrences([t for _, t in part], items)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
