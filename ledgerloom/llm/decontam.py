"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared as lower-case letters and digits with single spaces between. An item of m characters may occur
with up to e = MAX_ERROR * m edits. An occurrence with e edits shares at least m + 1 - q - q * e of the item's q-grams with the text,
all on neighbouring diagonals (place in the text minus place in the item). So shared q-grams are counted per item in overlapping bands
of diagonals; bands that reach the bound are regions, and a banded alignment of the item with the region verifies each. The lemma is
exact: no occurrence within the budget is lost.

Of the places of an item's q-grams, as many as the bound must have theirs in the text at all: items that have fewer are left before any
place is looked at. q is the largest up to Q that leaves a bound of MIN_SHARED or more for the item, or a smaller one where that is needed
for the bound to exceed the number of its q-grams that more than COMMON items have: an instruction that thousands of items share then
reaches no item's bound by itself. Regions of a text are aligned together, and each stops once its row has no cell within the budget.

Items under MIN_ITEM characters are no evidence of
contamination by themselves and are left out, unless the caller asks for them (short): then they match as whole words without an edit.
Items of equal compared text are looked for once. Texts are scanned once, whole, without a shuffle. The item index is broadcast in
blocks of at most BLOCK_CHARS characters, one pass over the texts per block, so its size is bounded whatever the benchmark's.

Defined results: null and empty texts and items match nothing; repeated items are each reported; repeated documents each get their rows;
null ids stay null. A document gets a row per item, for its best occurrence (fewest edits, then first). Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ready, session

Q, MAX_ERROR, MIN_SHARED, MIN_ITEM = 12, 0.06, 2, 20
#: Items that have a q-gram above which it counts as common, and the regions that are aligned together. They bound work, not results.
COMMON, TOGETHER = 64, 2048
BLOCK_CHARS = 4_000_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FILTER_BITS = 22


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point of the first plane, and whether it is a letter or digit."""
    lower, word = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        x = chr(c).lower()
        if len(x) == 1:
            lower[c] = ord(x)
        word[c] = chr(c).isalnum()
    return lower, word


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The compared code points, and each one's place in the text."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    lower, word = _tables()
    low = np.minimum(cp, 0xFFFF)
    is_word = word[low] | (cp > 0xFFFF)
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    at = np.flatnonzero(keep)
    out = np.where(cp > 0xFFFF, cp, lower[low])[at]
    out[~is_word[at]] = 32
    if len(out) and out[-1] == 32:
        out, at = out[:-1], at[:-1]
    return out, at


def qgrams(cp: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram, by doubling: hashes of 1, 2, 4, ... characters combine to q."""
    if len(cp) < q:
        return np.empty(0, np.uint64)
    part, width, factor = cp.astype(np.uint64) + np.uint64(1), 1, int(_BASE)
    out, done = None, 0
    rest = q
    while rest:
        if rest & 1:
            if out is None:
                out = part
            else:
                n = min(len(out), len(part) - done)
                out = out[:n] + part[done : done + n] * np.uint64(pow(int(_BASE), done, 1 << 64))
            done += width
        rest >>= 1
        if rest:
            part = part[: len(part) - width] + part[width:] * np.uint64(factor)
            width, factor = width * 2, factor * factor % (1 << 64)
    out = out[: len(cp) - q + 1] * _MIX
    return out ^ (out >> np.uint64(32))


def plan(m: int, max_error: float = MAX_ERROR, short: bool = False) -> tuple[int, int, int] | None:
    """q, the edit budget and the bound for an item of m characters."""
    if m < MIN_ITEM:
        q = min(Q, m)
        return (q, 0, m + 1 - q) if short and m else None
    e = int(max_error * m)
    for q in range(min(Q, m), 3, -1):
        if m + 1 - q - q * e >= MIN_SHARED:
            return q, e, m + 1 - q - q * e
    return min(4, m), e, max(1, m + 1 - 4 - 4 * e)


@dataclass(frozen=True)
class Item:
    """The ids of items with one compared text, its code points, edit budget and bound, its sorted q-grams and their places."""

    ids: list[int | None]
    cp: np.ndarray
    e: int
    bound: int
    grams: np.ndarray
    places: np.ndarray


@dataclass(frozen=True)
class Index:
    """Items and their bounds, and for each q: the distinct q-grams, where each one's entries begin, each entry's item, and a bit filter."""

    items: list[Item]
    by_q: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    bounds: np.ndarray


def _common(texts: list[np.ndarray], q: int) -> list[int]:
    """How many of each text's q-grams more than COMMON of the texts have."""
    grams = [qgrams(x, q) for x in texts]
    every, n = np.unique(np.concatenate([np.unique(g) for g in grams]), return_counts=True)
    common = every[n > COMMON]
    return [int(np.isin(g, common).sum()) for g in grams]


def build(items: list[tuple[int | None, str]], max_error: float = MAX_ERROR, short: bool = False) -> Index:
    of: dict[bytes, tuple[np.ndarray, list[int | None]]] = {}
    for item_id, text in items:
        cp = normal(text or "")[0]
        of.setdefault(cp.tobytes(), (cp, []))[1].append(item_id)
    plans = [(cp, ids, found) for cp, ids in of.values() if (found := plan(len(cp), max_error, short))]
    texts = [cp for cp, _, _ in plans]
    chosen = [found for _, _, found in plans]
    if len(plans) > COMMON:
        open_ = {k: (found[2] - 1, *found) for k, found in enumerate(chosen)}
        for q in range(Q, 3, -1):
            common = _common(texts, q) if open_ else []
            for k in list(open_):
                m, (_, first, e, _) = len(texts[k]), open_[k]
                bound = m + 1 - q - q * e
                if q > first or m < MIN_ITEM or bound < 1:
                    continue
                if q == first or bound - common[k] > open_[k][0]:
                    open_[k] = (bound - common[k], first, e, bound)
                    chosen[k] = (q, e, bound)
                if open_[k][0] > 0:  # the largest q that will do
                    del open_[k]
    kept, grams = [], {}
    for (cp, ids, _), (q, e, bound) in zip(plans, chosen, strict=True):
        h = qgrams(cp, q)
        order = np.argsort(h, kind="stable")
        grams.setdefault(q, []).append((h, np.full(len(h), len(kept))))
        kept.append(Item(ids, cp, e, max(1, bound), h[order], order))
    by_q = {}
    for q, parts in grams.items():
        h, owner = (np.concatenate([p[k] for p in parts]) for k in range(2))
        order = np.argsort(h, kind="stable")
        distinct = np.unique(h)
        begin = np.searchsorted(h[order], distinct)
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        by_q[q] = distinct, np.append(begin, len(h)), owner[order], bits
    return Index(kept, by_q, np.array([x.bound for x in kept], np.int64))


def align(items: list[np.ndarray], text: np.ndarray, starts: list[int], widths: list[int], budgets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per region: fewest edits of its item against the text, beginning on diagonals start to start + width - 1, and the end in the text.

    Row i holds the diagonals' distances after i characters of the item; diagonal k is at place start + k + i of the text. A region ends
    early, with budget + 1 edits, when no cell of its row is within the budget.
    """
    n, count = len(text), len(items)
    m, start, width, budget = np.array([len(x) for x in items]), np.array(starts), np.array(widths), np.array(budgets)
    edits, ends = budget + 1, np.zeros(count, np.int64)
    longest, widest = int(m.max()), int(width.max())
    chars = np.zeros((count, longest), np.uint32)
    for k, x in enumerate(items):
        chars[k, : len(x)] = x
    k = np.arange(widest)
    big = longest + widest + 1
    padded = np.concatenate([text, np.full(1, 0xFFFFFFFF, text.dtype)])
    live = np.arange(count)
    at = start[:, None] + k
    row = np.where((at >= 0) & (at <= n) & (k < width[:, None]), 0, big)
    for i in range(longest + 1):
        done = m[live] == i
        if done.any():
            over = live[done]
            best = row[done].argmin(1)
            edits[over], ends[over] = np.minimum(row[done, best], budget[over] + 1), start[over] + best + i
        on = ~done & (row.min(1) <= budget[live])
        if not on.all():
            live, row = live[on], row[on]
        if not len(live):
            break
        at = start[live][:, None] + k + i
        inside = (at >= 0) & (at < n)
        step = row + (padded[np.where(inside, at, n)] != chars[live, i][:, None])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(step - k, axis=1) + k
        row[(at + 1 < 0) | (at + 1 > n) | (k >= width[live][:, None])] = big
    return edits, ends


def _regions(item: Item, q: int, diagonal: np.ndarray) -> list[tuple[int, int]]:
    """(first diagonal, width) of the bands that reach the bound: bands of step + e diagonals, beginning at each multiple of step."""
    step = max(8, 2 * item.e)
    band = diagonal // step
    both = np.concatenate([band, band[diagonal - band * step < item.e] - 1])
    bands, n = np.unique(both, return_counts=True)
    return [(x * step - item.e, step + 3 * item.e + 1) for x in bands[n >= item.bound].tolist()]


def matches(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(number of the item, start, end, edits) of the best occurrence of each item in a text; code points, end exclusive."""
    cp, at = normal(text)
    best: dict[int, tuple[int, int, int]] = {}
    for q, (grams, begin, owner, bits) in index.by_q.items():
        h = qgrams(cp, q)
        if not len(h):
            continue
        p = np.flatnonzero(bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(grams, h[p]), len(grams) - 1)
        there = grams[place] == h[p]
        p = p[there]
        if not len(p):
            continue
        present = np.unique(place[there])
        size = begin[present + 1] - begin[present]
        entry = np.arange(int(size.sum())) + np.repeat(begin[present] - (np.cumsum(size) - size), size)
        shared = np.bincount(owner[entry], minlength=len(index.items))  # places of an item whose q-grams are in the text
        hp = h[p]
        todo: list[tuple[int, int, int]] = []
        for k in np.flatnonzero((shared >= index.bounds) & (shared > 0)).tolist():
            item = index.items[k]
            lo, hi = np.searchsorted(item.grams, hp, "left"), np.searchsorted(item.grams, hp, "right")
            n = hi - lo
            some, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            ends = np.cumsum(n)
            diagonal = np.repeat(some, n) - item.places[np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)]
            m = len(item.cp)
            found, count = np.unique(diagonal, return_counts=True)
            whole = next((x for x in found[count >= m + 1 - q].tolist() if np.array_equal(cp[x : x + m], item.cp) and (m >= MIN_ITEM or _whole_words(cp, x, x + m))), None)
            if whole is not None:  # a diagonal without an edit: the alignment's zero
                best[k] = (0, whole + m, whole)
            elif item.e:
                todo += [(k, *r) for r in _regions(item, q, diagonal)]
        for turn in range(0, len(todo), TOGETHER):
            some = todo[turn : turn + TOGETHER]
            edits, ends = align([index.items[k].cp for k, _, _ in some], cp, [a for _, a, _ in some], [w for _, _, w in some], [index.items[k].e for k, _, _ in some])
            for (k, _, _), d, end in zip(some, edits.tolist(), ends.tolist(), strict=True):
                if d <= index.items[k].e and (k not in best or (d, end) < best[k][:2]):
                    best[k] = (d, end, -1)
        for k in [k for k, x in best.items() if x[2] < 0]:  # the start, by aligning backwards from the end
            d, end, _ = best[k]
            item = index.items[k]
            back = align([item.cp[::-1]], cp[:end][::-1], [0], [1 + item.e], [item.e])[1][0]
            best[k] = (d, end, max(0, end - int(back)))
    out = []
    for k, (edits, end, first) in sorted(best.items()):
        first, end = max(0, min(first, len(at) - 1)), max(1, min(end, len(at)))
        out.append((k, int(at[first]), int(at[end - 1]) + 1, edits))
    return out


def _whole_words(cp: np.ndarray, a: int, b: int) -> bool:
    return (a == 0 or cp[a - 1] == 32) and (b == len(cp) or cp[b] == 32)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCHES = "doc_id long, item_id long, start long, end long, edits long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_error: float = MAX_ERROR, short: bool = False) -> DataFrame:
    """A row of MATCHES per document and item that occurs in it within the edit budget."""
    spark = session(docs)
    ready(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(build(block, max_error, short))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                rows = [(doc_id, item_id, a, b, edits) for doc_id, text in texts if text for k, a, b, edits in matches(text, index) for item_id in index.items[k].ids]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "start", "end", "edits"])

        out = out.unionByName(texts.mapInArrow(scan, MATCHES))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_error: float = MAX_ERROR) -> DataFrame:
    """docs without those that hold a benchmark item; null texts stay."""
    spark = session(docs)
    ready(spark)
    out = docs
    for block in _blocks(benchmark, "item_id", "text"):
        shared = spark.sparkContext.broadcast(build(block, max_error))
        place = docs.columns.index(text_col)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not (t and matches(t, shared.value)) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
