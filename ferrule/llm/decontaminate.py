"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Length of the q-grams, edits allowed per character of an item, and q-grams that its edits leave whole at least: short
#: items get a smaller budget, or any shared q-gram would be aligned, and no edits where none fits.
Q, RATE, WHOLE = 10, 0.08, 8
#: Characters of benchmark text that one pass over the documents is held against, and of documents looked at together.
BLOCK_CHARS, CHUNK = 4_000_000, 1 << 17
#: Shared q-grams that are counted at a time.
HITS = 1 << 19
#: A code that no character has: it stands between texts.
_GAP = np.uint32(0x110001)
_SPACE = np.uint32(32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BITMAP_BITS = 22

#: First and last code points of the scripts that put no spaces between words.
SPACELESS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]

Batches = Iterator[pa.RecordBatch]
#: A window of a text: the text's number, its codes, their positions, and whether the text goes on to the left and to the right of it.
Window = tuple[int, np.ndarray, np.ndarray, bool, bool]


@cache
def _folding() -> np.ndarray:
    """For each code point the lower-case letter or digit it stands for, or else a space."""
    table = np.full(0x110002, _SPACE, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalnum():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    table[_GAP] = _GAP
    return table


@cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits in lower case, with one space for anything between, as codes; and the position of each in the text."""
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = codes == _SPACE
    at = np.flatnonzero(~(space & np.concatenate([[False], space[:-1]])))
    return codes[at], at


def normalize(text: str) -> np.ndarray:
    """The codes of a text, without spaces at its ends."""
    codes, _ = _folded(text)
    a, b = (len(codes) > 0 and codes[k] == _SPACE for k in (0, -1))
    return codes[int(a) : len(codes) - int(b)]


def _windows(text: str, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of a text and their positions, in windows of about ``CHUNK`` codes; each starts with the last ``overlap`` of the one before."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, last = 0, _SPACE
    for k in range(0, len(text), CHUNK):
        codes, at = _folded(text[k : k + CHUNK])
        skip = int(len(codes) > 0 and codes[0] == _SPACE and last == _SPACE)
        codes, at = codes[skip:], at[skip:] + k
        if len(codes):
            last = codes[-1]
            held.append((codes, at))
            size += len(codes)
        if size >= CHUNK + overlap:
            whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            yield whole
            held = [tuple(x[len(x) - overlap :] for x in whole)]
            size = overlap
    if held:
        codes, at = (np.concatenate(x) for x in zip(*held, strict=True))
        end = len(codes) - int(len(codes) > 0 and codes[-1] == _SPACE)
        yield codes[:end], at[:end]


def _gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(codes)
    if n < q:
        return np.empty(0, np.uint64)
    size = 1 << max(18, int(n).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[:n])])
    h = (sums[q:] - sums[:-q]) * _powers(_INVERSE, size)[: n - q + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Index:
    """The q-grams of a block of benchmark items. ``need``: q-grams that a region within the edit budget shares at least.

    ``short`` has the items shorter than a q-gram: for each length the sorted hashes, and the items and ids in their order.
    """

    ids: list[int]
    items: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    bitmap: np.ndarray
    short: list[tuple[np.ndarray, np.ndarray, list[int]]]


def build(rows: list[tuple[int, str]], rate: float = RATE, whole: int = WHOLE) -> Index:
    ids, items = [], []
    brief: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for item_id, text in rows:
        codes = normalize(text)
        if len(codes) >= Q:
            ids.append(item_id)
            items.append(codes)
        elif len(codes):
            brief.setdefault(len(codes), []).append((int(_gram_hashes(codes, len(codes))[0]), item_id, codes))
    short = []
    for _, some in sorted(brief.items()):
        some = sorted(some, key=lambda x: x[:2])
        short.append((np.array([x[0] for x in some], np.uint64), np.array([x[2] for x in some]), [x[1] for x in some]))
    length = np.array([len(x) for x in items], np.int64)
    budget = np.maximum(np.minimum(rate * length, (length - Q + 1 - whole) // Q), 0).astype(np.int64)
    hashes = [_gram_hashes(x) for x in items]
    h = np.concatenate([np.empty(0, np.uint64), *hashes])
    item = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
    offset = np.concatenate([np.empty(0, np.int64), *[np.arange(len(x)) for x in hashes]]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    bitmap = np.zeros(1 << _BITMAP_BITS, bool)
    bitmap[grams >> np.uint64(64 - _BITMAP_BITS)] = True
    return Index(ids, items, budget, length - Q + 1 - Q * budget, grams, np.append(first, len(h)), item[order], offset[order], bitmap, short)


def _align(item: np.ndarray, region: np.ndarray, spread: int) -> tuple[int, int, int]:
    """Least edits between ``item`` and a stretch of ``region`` that starts in its first ``spread`` places, on those diagonals; with its start and end.

    Costs and starts share one number, so that the least is the one of fewest edits and then of first start.
    """
    one, far = 1 << 32, 1 << 60
    width = spread
    region = np.concatenate([region, np.full(max(0, width + len(item) - len(region)), _GAP, np.uint32)])
    slots = np.arange(width, dtype=np.int64)
    steps = slots * one
    row = slots.copy()  # nothing of the item used yet: no edits, start at each place
    for i in range(len(item)):
        change = row + np.where(region[i : i + width] == item[i], 0, one)
        skip = np.append(row[1:], far) + one
        row = np.minimum(change, skip)
        row = np.minimum.accumulate(row - steps) + steps
    best = int(row.argmin())
    return int(row[best] >> 32), int(row[best] & (one - 1)), best + len(item)


def find(texts: list[str | None], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """For each text the items in it: (item_id, start, end, edits), the best region of each item, in code points of the text.

    Short texts are looked at together, long ones in windows that overlap by more than any item's region; so memory goes with
    ``CHUNK`` and the longest item, not with a text.
    """
    best: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    reach = [len(x) + 4 * (int(b) + 1) for x, b in zip(index.items, index.budget, strict=True)]
    # With what stands on either side of it, each region is whole in some window.
    overlap = max([Q, *reach, *(items.shape[1] for _, items, _ in index.short)]) + 2
    group: list[Window] = []
    size = 0
    for k, text in enumerate(texts):
        windows = _windows(text or "", overlap)
        codes, at = next(windows, (np.empty(0, np.uint32),) * 2)
        goes_on = False
        while len(codes):
            more, there = next(windows, (np.empty(0, np.uint32),) * 2)
            group.append((k, codes, at, goes_on, len(more) > 0))
            size += len(codes)
            codes, at, goes_on = more, there, True
            if size >= CHUNK:
                _scan(group, index, best)
                group, size = [], 0
    _scan(group, index, best)
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    short = [i for _, _, ids in index.short for i in ids]
    for (number, kind, i), (edits, s, e) in sorted(best.items()):
        found[number].append(((index.ids, short)[kind][i], s, e, edits))
    return found


def _spaceless(codes: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([(codes >= a) & (codes <= b) for a, b in SPACELESS])


def _borders(codes: np.ndarray, begins: np.ndarray, group: list[Window]) -> np.ndarray:
    """Where no word goes on: spaces, ends of texts (but not of windows), and characters of scripts without spaces."""
    border = (codes == _SPACE) | (codes == _GAP) | _spaceless(codes)
    for k, (_, _, _, left, right) in enumerate(group):
        if left:
            border[begins[k] - 1] = False
        if right:
            border[begins[k + 1] - 1] = False
    return border


def _scan_short(codes: np.ndarray, begins: np.ndarray, border: np.ndarray, group: list[Window], index: Index, best: dict[tuple[int, int, int], tuple[int, int, int]]) -> None:
    """The first place in each text of each item shorter than a q-gram, as it stands, between borders of words."""
    before = 0
    for hashes, items, ids in index.short:
        n = items.shape[1]
        h = _gram_hashes(codes, n)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        at = np.flatnonzero(high > low)
        times = (high - low)[at]
        item = np.repeat(low[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(at) else at
        at = np.repeat(at, times)
        real = (codes[at[:, None] + np.arange(n)] == items[item]).all(1)
        at, item = at[real], item[real]
        whole = (border[at - 1] | border[at]) & (border[at + n] | border[at + n - 1])
        at, item = at[whole], item[whole]
        d = np.searchsorted(begins, at, "right") - 1
        _, first = np.unique(d * len(ids) + item, return_index=True)
        for k in first.tolist():
            number, _, origin, _, _ = group[d[k]]
            a = int(at[k] - begins[d[k]])
            key, hit = (number, 1, before + int(item[k])), (0, int(origin[a]), int(origin[a + n - 1]) + 1)
            best[key] = min(best.get(key, hit), hit)
        before += len(ids)


def _bands(codes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The bands of diagonals that share enough q-grams with an item: item, and number of the band, in the order of both.

    Shared q-grams are counted ``HITS`` at a time, so that memory goes with the bands and not with how often a text that
    repeats itself meets an item that does.
    """
    h = _gram_hashes(codes)
    at = np.flatnonzero(index.bitmap[h >> np.uint64(64 - _BITMAP_BITS)])
    slot = np.searchsorted(index.grams, h[at])
    slot[slot == len(index.grams)] = 0
    real = index.grams[slot] == h[at]
    at, slot = at[real], slot[real]
    times = index.first[slot + 1] - index.first[slot]
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    done = np.concatenate([[0], np.cumsum(times)])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(done, done[a] + HITS, "right")) - 1)
        some = times[a:b]
        entry = np.repeat(index.first[slot[a:b]] - (done[a:b] - done[a]), some) + np.arange(done[b] - done[a])
        item, diagonal = index.item[entry], np.repeat(at[a:b], some) - index.offset[entry]
        # Matches within the budget keep to budget + 1 diagonals, so a band of twice that, from every multiple, holds them all.
        low = diagonal // (index.budget[item] + 1)
        new, n = np.unique(np.concatenate([item, item]) * (1 << 32) + np.concatenate([low, low - 1]) + (1 << 31), return_counts=True)
        keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        a = b
    which = keys >> 32
    keep = counts >= index.need[which]
    return which[keep], (keys[keep] & ((1 << 32) - 1)) - (1 << 31)


def _scan(group: list[Window], index: Index, best: dict[tuple[int, int, int], tuple[int, int, int]]) -> None:
    if not group:
        return
    gap = np.array([_GAP], np.uint32)
    codes = np.concatenate([gap, *[x for _, c, *_ in group for x in (c, gap)]])
    begins = np.cumsum([1, *[len(c) + 1 for _, c, *_ in group]])
    border = _borders(codes, begins, group)
    _scan_short(codes, begins, border, group, index, best)
    if not index.items:
        return
    which, bands = _bands(codes, index)
    for k, i in zip(bands.tolist(), which.tolist(), strict=True):
        step, pattern = int(index.budget[i]) + 1, index.items[i]
        start = k * step
        d = int(np.searchsorted(begins, max(start, 0) + len(pattern) // 2, "right")) - 1
        if d >= len(group):
            continue
        number, own, origin, _, _ = group[d]
        a = max(start - int(begins[d]), 0)
        if best.get((number, 0, i), (1,))[0] == 0:
            continue  # nothing beats no edits, and bands come in order
        # Diagonals before the text's first are there, too, with nothing on them: edits may lead back to them.
        blank = max(int(begins[d]) - start, 0)
        region = np.concatenate([np.full(blank, _GAP, np.uint32), own[a : a + 2 * step + len(pattern) - blank]])
        whole = region.tobytes().find(pattern.tobytes())
        if whole >= 0 and whole % 4 == 0:
            edits, s, e = 0, whole // 4, whole // 4 + len(pattern)
        else:
            edits, s, e = _align(pattern, region, 2 * step)
        s, e = max(s - blank, 0), e - blank
        if edits < step and e > 0 and a + s < len(own):
            last = min(a + e, len(own)) - 1
            first_at, last_at = int(begins[d]) + a + s, int(begins[d]) + last
            if not index.budget[i] and not ((border[first_at - 1] or border[first_at]) and (border[last_at + 1] or border[last_at])):
                continue  # an item without room for edits is one of whole words
            hit = (edits, int(origin[a + s]), int(origin[last]) + 1)
            best[number, 0, i] = min(best.get((number, 0, i), hit), hit)


def _blocks(benchmark: DataFrame, rate: float, whole: int, nameless: bool = False) -> Iterator[Index]:
    """The benchmark in blocks of about ``BLOCK_CHARS`` characters, so that what is broadcast stays bounded.

    Rows of a null item_id are left out, or if ``nameless``, all rows are in, under their number in the block.
    """
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if nameless:
            yield build(list(enumerate(sorted(r.text for r in rows))), rate, whole)
        else:
            yield build(sorted((r.item_id, r.text) for r in rows if r.item_id is not None), rate, whole)


def _map(docs: DataFrame, index: Index, run: Callable[[pa.RecordBatch, Index], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.mapInArrow(lambda batches: (run(batch, shared.value) for batch in batches), schema)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, whole: int = WHOLE) -> DataFrame:
    """The benchmark items that documents hold, with at most ``rate`` edits a character: doc_id, item_id, start, end, edits.

    Documents and items are compared as lower-case letters and digits with single spaces between. One row for each document
    and item, the region of fewest edits and then first; positions are code points of the whole text, end exclusive.
    Documents are not shuffled: q-grams that a document shares with an item are counted in overlapping bands of diagonals;
    a band that reaches the number which the edit budget leaves untouched is aligned. The budget of an item of n characters is
    the lesser of ``rate`` * n and (n - Q + 1 - ``whole``) / Q, so that ``whole`` q-grams stay: 8 % from about 85 characters on,
    4 edits at 57, 1 at 27, none below; items shorter than a q-gram are looked for as they stand. An item
    without room for edits is found between borders of words only, not within one; scripts without spaces have borders everywhere. An item counts as a whole: what a document leaves out of it are edits, so of a long item it must hold
    ``1 - rate`` of the characters, in one region, and a longer part cut off hides it. Items without letters and digits, and
    null texts, match nothing; repeated rows match alike; rows of a null item_id are left out, since they have no name to
    give (``clean`` looks for them, too); an empty benchmark matches nothing; other columns are ignored.
    """

    def run(batch: pa.RecordBatch, index: Index) -> pa.RecordBatch:
        rows = [(d, *m) for d, ms in zip(batch.column("doc_id").to_pylist(), find(batch.column("text").to_pylist(), index), strict=True) for m in ms]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "edits"])

    schema = "doc_id long, item_id long, start long, end long, edits long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, rate, whole):
        found = found.unionByName(_map(docs, index, run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, whole: int = WHOLE) -> DataFrame:
    """The documents that hold no benchmark item, as ``matches`` finds them, with all their columns; items of a null item_id count, too.

    Documents of a null doc_id are judged like others, those of null or empty text stay, and repeated rows stay or go together;
    an empty table stays empty, and an empty benchmark takes nothing away. Columns of any name are kept, for none is added.
    """

    def run(batch: pa.RecordBatch, index: Index) -> pa.RecordBatch:
        return batch.filter(pa.array([not x for x in find(batch.column("text").to_pylist(), index)], pa.bool_()))

    for index in _blocks(benchmark, rate, whole, nameless=True):
        docs = _map(docs, index, run, docs.schema)
    return docs
