"""How far the term shares of the sources of a language lie apart, over a quadtree of the counts.

The counts of all terms in all groups (a language and a source) are a sparse matrix. Columns are dealt
into blocks, rows into blocks of groups, and each tile is a quadtree: a node has four bits, one for each
quadrant that holds a count. Two groups are compared by walking down the trees of their row blocks
together: where both quadrants are empty, all their columns have one price, known from the totals of the
two groups alone; only columns in which one of the two has a count are looked at one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import raw, stored

SCALE = 1_000_000_000
#: Columns and groups of a tile, on average and at most.
COLUMNS, GROUPS = 4096, 256
#: Pairs of quadrants that are walked down at once.
FRONTIER = 500_000
#: Different terms of a task that are held before they are passed on.
HELD_TERMS = 300_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in two steps that stay within 64 bits."""
    x, whole = (count + 1) * 32_000, total + terms
    return 1 + x // whole * 31_250 + x % whole * 31_250 // whole


def _share(count: str, total: str, terms: str = "terms") -> str:
    """`share` as a SQL expression."""
    x, whole = f"(({count} + 1) * 32000L)", f"({total} + {terms})"
    return f"(1 + ({x} div {whole}) * 31250L + (({x} % {whole}) * 31250L) div {whole})"


def _apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


class QuadTree:
    """A sparse matrix of counts as levels of bits: four for each node that is not empty, in Morton order."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, levels: int):
        code = np.zeros(len(rows), np.int64)
        for k in range(levels):
            code |= ((rows >> k & 1) << 1 | columns >> k & 1).astype(np.int64) << 2 * k
        order = np.argsort(code)
        code = code[order]
        #: Counts of the cells, in the order of the last level's bits that are set.
        self.counts = counts[order]
        self.bits: list[np.ndarray] = []
        self.rank: list[np.ndarray] = []
        above = np.zeros(1, np.int64) if len(code) else code
        for level in range(1, levels + 1):
            here = np.unique(code >> 2 * (levels - level))
            bits = np.zeros(4 * len(above), bool)
            bits[np.searchsorted(above, here >> 2) * 4 + (here & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - 1)
            above = here

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The nodes below, by number within their level; -1 for an empty quadrant, also below an empty one."""
        if not len(self.bits[level]):
            return np.full(len(node), -1, np.int64)
        slot = np.maximum(node, 0) * 4 + quadrant
        return np.where((node >= 0) & self.bits[level][slot], self.rank[level][slot], -1)


def walk(left: QuadTree, right: QuadTree, n_left: int, n_right: int, levels: int, same: bool) -> Iterator[tuple]:
    """Go down both trees over the same columns, for all pairs of a row of each, or of two rows of one tree.

    Yields arrays (left row, right row, left count, right count) with one entry for each column in which
    one of the two rows has a count. Pairs of empty quadrants are left at once, whatever their size.
    """
    zero = np.zeros(1, np.int64)
    empty = len(left.counts) == 0, len(right.counts) == 0
    stack = [(0, zero - empty[0], zero - empty[1], zero, zero)]
    while stack:
        level, a, b, row_a, row_b = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack.append((level, a[half:], b[half:], row_a[half:], row_b[half:]))
            stack.append((level, a[:half], b[:half], row_a[:half], row_b[:half]))
            continue
        if level == levels:
            counts = [np.where(x >= 0, t.counts[np.maximum(x, 0)] if len(t.counts) else 0, 0) for x, t in ((a, left), (b, right))]
            yield row_a, row_b, *counts
            continue
        rest = levels - level - 1
        parts = []
        for down_a in (0, 1):
            x = row_a * 2 + down_a
            for down_b in (0, 1):
                y = row_b * 2 + down_b
                there = (x << rest < n_left) & (y << rest < n_right)
                if same:
                    there &= x < y if not rest else x <= y
                for across in (0, 1):
                    next_a = left.child(level, a, 2 * down_a + across)
                    next_b = right.child(level, b, 2 * down_b + across)
                    on = np.flatnonzero(there & ((next_a >= 0) | (next_b >= 0)))
                    parts.append((next_a[on], next_b[on], x[on], y[on]))
        joined = [np.concatenate(p) for p in zip(*parts)]
        if len(joined[0]):
            stack.append((level + 1, *joined))


def tile_sums(groups: tuple, other: tuple | None, columns: int, terms: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sums over the columns of a tile in which one of two groups has a count: (left, right, sum, reverse sum, columns).

    `groups` and `other` are (totals of the groups, rows, columns, counts of the cells); without
    `other` the groups are paired with one another.
    """
    sides = [groups, other or groups]
    levels = max(int(max(columns, *(len(s[0]) for s in sides)) - 1).bit_length(), 1)
    trees = [QuadTree(s[1], s[2], s[3], levels) for s in sides]
    shape = len(sides[0][0]), len(sides[1][0])
    there, back, seen = (np.zeros(shape[0] * shape[1], np.int64) for _ in range(3))
    for row_a, row_b, a, b in walk(*trees, *shape, levels, other is None):
        p, q = share(a, sides[0][0][row_a], terms), share(b, sides[1][0][row_b], terms)
        gap, pair = (p - q) * (p - q), row_a * shape[1] + row_b
        np.add.at(there, pair, gap // q)
        np.add.at(back, pair, gap // p)
        np.add.at(seen, pair, 1)
    pairs = np.flatnonzero(seen)
    yield pairs // shape[1], pairs % shape[1], there[pairs], back[pairs], seen[pairs]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            for column, values in zip(out, ([lang] * len(terms), [source] * len(terms), terms, [0, *n.values()], [0, *map(docs.__getitem__, n)])):
                column.extend(values)
        held.clear()
        out[2] = pa.array(out[2], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, COUNTS)], schema=COUNTS)

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(_LETTERS).split()
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) >= HELD_TERMS:
            yield rows()
    if held:
        yield rows()


def count_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """Counts of the kept terms, stored: lang, source, term, n, lang_n, leads; and a row of each group with the term ''.

    Terms are matches of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased. Kept are those
    in at least `least_docs` documents of the language. lang_n is the count in the whole language,
    `leads` is true in one row of each term of a language.
    """
    slim = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        F.coalesce(raw(), F.lit(b"")).alias("text"),
    )
    counted = slim.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # Dealt by term, the sums by group and by language need no other shuffle.
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    kept = summed.select(
        "lang", "source", "term", "n",
        F.sum("n").over(over).alias("lang_n"),
        F.sum("docs").over(over).alias("lang_docs"),
        (F.min("source").over(over) == F.col("source")).alias("leads"),
    )
    return stored(kept.filter((F.col("term") == "") | (F.col("lang_docs") >= least_docs)).drop("lang_docs"), "terms")


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each ordered pair of groups of one language."""
    tiled = groups.withColumn("blocks", F.expr(f"(terms + {COLUMNS} - 1) div {COLUMNS}"))
    of_group = tiled.select("lang", "source", "number", "total", "terms", "row_blocks", "blocks")
    # Each tile knows all groups of its row blocks, also those without a count in it.
    heads = of_group.filter("blocks > 0").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    heads = heads.select("lang", "number", "total", "terms", "row_blocks", "block", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"))
    counts = cells.filter("term <> ''").join(of_group, ["lang", "source"])
    counts = counts.select("lang", "number", "total", "terms", "row_blocks", F.expr("pmod(xxhash64(term), blocks)").alias("block"), "term", "n")
    own = F.expr(f"number div {GROUPS}")
    entries = heads.unionByName(counts).withColumn("own", own).withColumn("met", F.explode(F.expr("sequence(0L, row_blocks - 1)")))
    entries = entries.select("lang", F.least("own", "met").alias("upper"), F.greatest("own", "met").alias("lower"), "block", "own", "number", "total", "terms", "term", "n")
    schema = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64()), ("seen", pa.int64())])

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        lang, upper, lower = key[0], key[1].as_py(), key[2].as_py()
        own, number, total, count = (table.column(c).to_numpy() for c in ("own", "number", "total", "n"))
        codes = table.column("term").combine_chunks().dictionary_encode()
        column, head = codes.indices.to_numpy(), table.column("term").to_numpy() == ""
        sides = []
        for side in dict.fromkeys((upper, lower)):
            mine = own == side
            first = np.flatnonzero(mine & head)
            numbers = number[first]
            turn = np.argsort(numbers)
            cells = np.flatnonzero(mine & ~head)
            sides.append((numbers[turn], (total[first][turn], np.searchsorted(numbers[turn], number[cells]), column[cells], count[cells])))
        names = [s[0] for s in (sides[0], sides[-1])]
        out = tile_sums(sides[0][1], sides[1][1] if len(sides) > 1 else None, len(codes.dictionary), int(table.column("terms")[0].as_py()))
        parts: list[list] = [[], [], [], []]
        for a, b, there, back, seen in out:
            a, b = names[0][a], names[1][b]
            for part, values in zip(parts, ((a, b), (b, a), (there, back), (seen, seen))):
                part.extend(values)
        values = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
        return pa.table([pa.array([lang.as_py()] * len(values[0]), pa.string()), *map(pa.array, values)], schema=schema)

    sums = entries.groupBy("lang", "upper", "lower", "block").applyInArrow(tile, "lang string, a long, b long, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    left = of_group.select("lang", "terms", "source", F.col("number").alias("a"), F.col("total").alias("total_a"))
    right = of_group.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("total").alias("total_b"))
    both = left.join(right, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    empty = _apart(_share("0", "total_a"), _share("0", "total_b"))
    price = F.expr(f"IF(terms > 0, {empty}, 0L) * (terms - coalesce(seen, 0L)) + coalesce(value, 0L)")
    return both.select("lang", "source", "item", price.alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """Divergence of the term shares of each group (language and source): lang, source, part, item, value, rank.

    The share of a term in a group is p = 1 + floor(SCALE * (count + 1) / (N + V)), N the group's count
    of all V kept terms (`count_terms`). Part `pair`: item is each other source of the language, value
    the sum over all kept terms of floor((p - q)^2 / q), q its share; 0 without any kept term. Part
    `term`: item is a term of the group with a larger share p than q, that of the whole language, value
    the floor((p - q)^2 / q) of it alone; only the first `most_terms`. Ranks count from 1 for each
    group and part, by falling value, then item in the order of its UTF-8 bytes. Counts up to 10^14
    are exact.

    A null text, lang or source counts as ''. Groups without terms take part in pairs. Every row
    counts, also a repeated one. A language with one source has no pairs; an empty table gives an
    empty result. Columns besides text, lang and source, whatever their names, are not read.
    """
    cells = count_terms(docs, least_docs)
    langs = cells.groupBy("lang").agg(
        F.count_if((F.col("term") != "") & F.col("leads")).alias("terms"),
        F.sum("n").alias("lang_total"),
    )
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", "total",
        (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("number"),
        F.expr(f"(count(*) OVER (PARTITION BY lang) + {GROUPS} - 1) div {GROUPS}").alias("row_blocks"),
    )
    groups = stored(groups.join(langs, "lang"), "groups")
    placed = cells.filter("term <> '' AND n > 0").join(groups, ["lang", "source"])
    placed = placed.select("lang", "source", F.col("term").alias("item"), F.expr(_share("n", "total")).alias("p"), F.expr(_share("lang_n", "lang_total")).alias("q"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    own = placed.filter("p > q").select("lang", "source", "item", F.expr(_apart("p", "q")).alias("value"))
    own = own.withColumn("rank", rank).filter(F.col("rank") <= most_terms)
    pairs = _pairs(cells, groups).withColumn("rank", rank)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(own.withColumn("part", F.lit("term")).select(columns))
