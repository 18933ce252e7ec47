"""Runs of a text: the longest stretches of words that repeat with one period.

The suffixes of all texts of a batch are sorted together (each text has symbols of its own, so that
the suffixes of one text lie together). Where neighbours in that order share just d words, an LCP
interval of depth d ends: its suffixes are the places of one passage of d words. A square of period d
whose two halves are followed by different words is a pair of suffixes i and i + d that lie in one such
interval but in different children. So for each interval the suffixes of all children but the largest
look up, in the inverse suffix array, where i + d and i - d lie. Turning such a square to the left as
long as the words agree gives the whole run, which ends where the square ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.common import arrow_rows, raw, texts

#: Words whose suffixes are sorted at once, besides one text of any length.
BATCH_WORDS = 300_000
#: This many suffixes of one interval and more are looked up as arrays.
WIDE = 64


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP of each suffix with the one before it, by doubling lengths.

    Only suffixes that still share a rank are sorted again. `symbols` counts from 0.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranks = [symbols.astype(np.int32)]  # per doubling, equal for suffixes that share 1, 2, 4, ... words
    rank = np.empty(n, np.int32)
    sorted_symbols = symbols[order]
    heads = np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1]))
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    ranks[0] = rank.copy()
    length = 1
    while True:
        # Places in the order whose suffix shares its rank with a neighbour.
        open_ = np.flatnonzero(~(heads & np.concatenate((heads[1:], [True]))))
        if not len(open_):
            break
        suffix = order[open_]
        after = suffix + length
        following = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        own = rank[suffix]
        turn = np.argsort(own.astype(np.int64) * (n + 1) + following + 1, kind="stable")
        order[open_] = suffix[turn]
        own, following = own[turn], following[turn]
        heads[open_] = np.concatenate(([True], (own[1:] != own[:-1]) | (following[1:] != following[:-1])))
        rank[order[open_]] = np.maximum.accumulate(np.where(heads[open_], open_, 0))
        ranks.append(rank.copy())
        length *= 2
    lcp = np.zeros(n, np.int32)
    pairs = np.flatnonzero(np.concatenate(([False], sorted_symbols[1:] == sorted_symbols[:-1])))
    a, b = order[pairs - 1].copy(), order[pairs].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
        a[same] += 1 << level
        b[same] += 1 << level
    lcp[pairs] = a - order[pairs - 1]
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    return order, inverse, lcp


def _squares_of(depth: int, low: int, cuts: list[int], high: int, lists: tuple, arrays: tuple, found: set) -> None:
    """Squares of one interval [low, high] whose children begin at `low` and at each of `cuts`."""
    starts = [low, *cuts, high + 1]
    widths = [b - a for a, b in zip(starts, starts[1:])]
    widest = widths.index(max(widths))
    if high + 1 - low - widths[widest] < WIDE:
        order, inverse = lists
        n = len(order)
        for c, first in enumerate(starts[:-1]):
            if c == widest:
                continue
            end = starts[c + 1]
            for place in range(first, end):
                i = order[place]
                if i + depth < n:
                    at = inverse[i + depth]
                    if low <= at <= high and not first <= at < end:
                        found.add((depth, i))
                if i >= depth:
                    at = inverse[i - depth]
                    if low <= at <= high and not first <= at < end:
                        found.add((depth, i - depth))
        return
    order, inverse = arrays
    bounds = np.asarray(starts)
    places = np.concatenate((np.arange(low, bounds[widest]), np.arange(bounds[widest + 1], high + 1)))
    child = np.searchsorted(bounds, places, "right") - 1
    i = order[places]
    for j, first in ((i + depth, i), (i - depth, i - depth)):
        inside = np.flatnonzero((j >= 0) & (j < len(order)))
        at, own = inverse[j[inside]], child[inside]
        hit = (at >= low) & (at <= high) & ((at < bounds[own]) | (at >= bounds[own + 1]))
        found.update((depth, k) for k in first[inside[hit]].tolist())


def branching_squares(order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int]]:
    """(period, start) of each square whose halves are followed by different words, shortest period first.

    One pass over the LCP values with a stack of open intervals; no tree is built.
    """
    found: set[tuple[int, int]] = set()
    arrays, lists, lcp = (order, inverse), (order.tolist(), inverse.tolist()), lcp.tolist()
    stack: list[tuple[int, int, list[int]]] = []  # depth, first place, places where children begin
    for place in range(1, len(lcp) + 1):
        depth = lcp[place] if place < len(lcp) else 0
        low = place - 1
        while stack and stack[-1][0] > depth:
            inner, low, cuts = stack.pop()
            _squares_of(inner, low, cuts, place - 1, lists, arrays, found)
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(place)
            else:
                stack.append((depth, low, [place]))
    return sorted(found)


def _turned(symbols: np.ndarray, start: int, period: int) -> int:
    """How far to the left words agree with those one period on: the start of the run."""
    step = 32
    while start > 0:
        low = max(0, start - step)
        unlike = np.flatnonzero(symbols[low:start] != symbols[low + period : start + period])
        if len(unlike):
            return low + int(unlike[-1]) + 1
        start, step = low, step * 4
    return 0


def runs_of(symbols: np.ndarray, order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text with at least `shortest` words, by start and period.

    Squares come with rising periods, so one that lies in a run of a part of its period, with the same
    end, is that run again and is left out before it is turned.
    """
    ends: dict[int, list[tuple[int, int]]] = {}
    for period, at in branching_squares(order, inverse, lcp):
        known = ends.setdefault(at + 2 * period, [])
        if not any(period % p == 0 and start <= at for start, p in known):
            known.append((_turned(symbols, at, period), period))
    runs = [(start, end - start, p) for end, known in ends.items() for start, p in known]
    return sorted((r for r in runs if r[1] >= shortest), key=lambda r: (r[0], r[2]))


def batch_runs(texts_words: list[list[bytes]], shortest: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words; all their suffixes are sorted together.

    A run of `shortest` words or more holds two equal stretches, one period apart, of half as many
    words; texts in which no so long stretch occurs twice have none and are passed over.
    """
    numbered, base = [], 0
    for words in texts_words:
        own: dict[bytes, int] = {}
        numbered.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int32, len(words)) + base)
        base += len(own)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts_words]
    symbols = np.concatenate(numbered) if numbered else np.zeros(0, np.int32)
    if not len(symbols):
        return out
    order, inverse, lcp = suffix_order(symbols)
    first = 0
    for k, own in enumerate(numbered):
        end = first + len(own)
        near = lcp[first:end]
        if len(near) >= shortest and near.max() >= max(1, (shortest + 1) // 2):
            out[k] = runs_of(own, order[first:end] - first, inverse[first:end] - first, near, shortest)
        first = end
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first `period` words."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))),
     ("collapsed", pa.string())]
)
KINDS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """Every run of every whole text: doc_id, n_words, runs (start, length, period), collapsed.

    Words are what white space (tab to carriage return, and the space) parts, compared exactly. A run
    is a stretch of at least `shortest` words, and of at least two of its smallest periods, that no
    neighbouring word extends. `runs` is ordered by start and period; `collapsed` joins by one space
    the words that no run contains after its first period.

    One row per input row, also for repeated rows. A null or empty text, or one without words, has no
    words and no runs; a null doc_id stays null; an empty table gives an empty one. Texts of any
    length are taken whole: a text's suffixes are sorted in one task, in memory that grows with it.
    Other columns, whatever their names, are not read.
    """
    return texts(docs).select("doc_id", raw()).mapInArrow(_search(shortest), KINDS)


def _search(shortest: int):
    if shortest < 2:
        raise ValueError("a run has two words at least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, words = 0, 0, []
            for at, text in enumerate(batch.column(1)):
                words.append((text.as_py() or b"").split())
                held += len(words[-1])
                if held >= BATCH_WORDS or at + 1 == batch.num_rows:
                    runs = batch_runs(words, shortest)
                    given = [[dict(zip(("start", "length", "period"), run)) for run in r] for r in runs]
                    left = [b" ".join(kept_words(w, r)).decode() for w, r in zip(words, runs)]
                    yield arrow_rows(SCHEMA, [batch.column(0).slice(start, len(words)), list(map(len, words)), given, left])
                    start, held, words = at + 1, 0, []

    return search
