"""Benchmark decontamination by greedy string tiling.

Documents and test items meet where they share a seed, a run of words found by its Karp-Rabin hash.
For each such pair the longest common runs are marked first, none over another, until only runs
shorter than a seed are left. The share of the item under marks is its coverage, in whatever order
its passages stand in the document.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import arrow_rows, texts

SEED_WORDS = 5
COVERAGE = 0.5
#: Test items are sent to the executors in blocks of at most about so many words.
BLOCK_WORDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = string.punctuation.encode()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode(errors="replace").translate(None, _PUNCTUATION).split()


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` numbers, modulo 2 ** 64."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = out * BASE + ids[k : k + len(out)].astype(np.uint64)
    return out


def tile(doc: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, words), longest first; `hits` are the places of equal seeds.

    Of equally long ones the first in the document, then in the item, is marked. What is left of a
    run beside marked words is tried again.
    """
    starts = set(hits)
    runs = []
    for i, j in hits:
        if (i - 1, j - 1) not in starts:
            length = seed
            while (i + length - seed + 1, j + length - seed + 1) in starts:
                length += 1
            runs.append((-length, i, j))
    heapq.heapify(runs)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles = []
    while runs:
        length, i, j = heapq.heappop(runs)
        length = -length
        marked = in_doc[i : i + length] | in_item[j : j + length]
        if not marked.any():
            in_doc[i : i + length] = in_item[j : j + length] = True
            tiles.append((i, j, length))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], marked, [True])).astype(np.int8)))
        for low, high in zip(edges[::2], edges[1::2]):
            if high - low >= seed:
                heapq.heappush(runs, (-int(high - low), i + int(low), j + int(low)))
    return tiles


@dataclass
class Index:
    """Words, seeds and word numbers of a block of test items; `names` has the item_id of each text."""

    seed: int
    numbers: dict[bytes, int]
    names: list[int]
    items: list[np.ndarray]
    hashes: np.ndarray
    places: dict[int, list[tuple[int, int]]]

    @staticmethod
    def of(items: list[tuple[int, str]], seed: int) -> Index:
        numbers: dict[bytes, int] = {}
        coded = []
        places: dict[int, list[tuple[int, int]]] = {}
        for item, (_, text) in enumerate(items):
            ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)], np.int64)
            coded.append(ids)
            for at, key in enumerate(rolling(ids, seed).tolist()):
                places.setdefault(key, []).append((item, at))
        return Index(seed, numbers, [name for name, _ in items], coded, np.array(sorted(places), np.uint64), places)

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """item_id, coverage, number of tiles and words of the longest, of every item that shares a seed.

        Of several texts of one item_id, the one with the best coverage is given.
        """
        words = words_of(text)
        if len(words) < self.seed or not len(self.hashes):
            return []
        ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        at = np.flatnonzero(known[self.seed :] - known[: -self.seed] == self.seed)
        if not len(at):
            return []
        keys = rolling(ids, self.seed)[at]
        found = np.searchsorted(self.hashes, keys)
        hit = self.hashes[np.minimum(found, len(self.hashes) - 1)] == keys
        pairs: dict[int, list[tuple[int, int]]] = {}
        for i, key in zip(at[hit].tolist(), keys[hit].tolist()):
            for item, j in self.places[key]:
                if (ids[i : i + self.seed] == self.items[item][j : j + self.seed]).all():
                    pairs.setdefault(item, []).append((i, j))
        best: dict[int, tuple[int, float, int, int]] = {}
        for item, hits in sorted(pairs.items()):
            tiles = tile(ids, self.items[item], hits, self.seed)
            words_under = sum(t[2] for t in tiles)
            name, share = self.names[item], words_under / len(self.items[item])
            if name not in best or share > best[name][1]:
                best[name] = name, share, len(tiles), tiles[0][2]
        return list(best.values())


def indexes(benchmark: DataFrame, seed: int = SEED_WORDS) -> Iterator[Index]:
    """The benchmark (item_id, text) in blocks of about BLOCK_WORDS words, all texts of one item_id in one.

    Items with fewer words than a seed are left out.
    """
    items = texts(benchmark.withColumnRenamed("item_id", "doc_id")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = 1 + words // BLOCK_WORDS
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k)
        yield Index.of([(r["doc_id"], r["text"]) for r in block.sort("doc_id", "text").collect()], seed)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS) -> DataFrame:
    """Pairs of a document and a test item that it covers: doc_id, item_id, coverage, n_tiles, longest.

    A pair is given if tiles of at least `seed` words cover `coverage` or more of the item's words.
    Words are lower-cased and stripped of ASCII punctuation. Null texts have no words; items with a
    null item_id or fewer words than a seed cannot be found; of several texts of one item_id the
    best covered one counts. Repeated documents give their pairs again. Texts of any length are searched whole; empty
    tables give an empty one; other columns are not read. However large the benchmark, it is
    searched in blocks of BLOCK_WORDS words, one pass over the documents each.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()),
         ("longest", pa.int32())]
    )
    spark = docs.sparkSession
    out = None
    for index in indexes(benchmark, seed):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[list] = [[] for _ in schema]
                for doc, text in zip(batch.column(0), batch.column(1)):
                    for match in shared.value.matches(text.as_py()):
                        if match[1] >= coverage:
                            for column, value in zip(rows, (doc.as_py(), *match)):
                                column.append(value)
                yield arrow_rows(schema, rows)

        found = texts(docs).mapInArrow(search, "doc_id long, item_id long, coverage double, n_tiles int, longest int")
        out = found if out is None else out.unionByName(found)
    return out


def leak_columns(spark, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS):
    """A function of a text column: whether the text covers a test item, by the rule of `find_leaks`."""
    blocks = [spark.sparkContext.broadcast(index) for index in indexes(benchmark, seed)]

    def one(shared):
        @F.pandas_udf("boolean")
        def leaks(text: pd.Series) -> pd.Series:
            own = shared.value
            return pd.Series([any(m[1] >= coverage for m in own.matches(t)) for t in text], dtype=bool)

        return leaks

    def columns(text: Column) -> Column:
        found = [one(b)(text.cast("string")) for b in blocks]
        out = found[0]
        for other in found[1:]:
            out = out | other
        return out

    return columns
