"""Shards of near equal size by a histogram sort.

Keys order the rows. Rounds of exact histograms narrow down the keys at which the bytes below meet
the targets; rows then move once. Only histograms, never keys or rows, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored

KEY_BITS = 64
#: Bits that each round adds to the candidate boundaries: 4,096 probes within each open interval.
ROUND_BITS = 12


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and eight), text_crc32 and the sort key of each row.

    The key's upper half is of the text, its lower half of the doc_id: equal texts lie side by side,
    yet a group of any size can be cut between its documents.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = F.lit(0xFFFFFFFF)
    doc = F.col("doc_id").cast("long")
    return docs.select(
        doc.alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(~0xFFFFFFFF).bitwiseOR(F.xxhash64(doc).bitwiseAND(half)).alias("key"),
    )


def splitters(rows: DataFrame, n: int, tolerance: float) -> list[int]:
    """n - 1 rising keys; as many bytes as possible of row k have k/n of all bytes below them.

    An interval that holds a target is cut anew until the bytes below a boundary miss the target by
    at most `tolerance` of a share, or until the interval is a single key.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * k / n for k in range(1, n)]
    allowed = tolerance * total / n
    found: dict[int, int] = {}
    #: Open targets by the prefix of keys that holds them, and the bytes below that prefix.
    open_at: dict[int | None, list[int]] = {None: list(range(n - 1))}
    below = {None: 0}
    bits = 0
    while open_at and total:
        shift = max(0, KEY_BITS - bits - ROUND_BITS)
        cells = rows
        if None not in open_at:
            cells = rows.filter(F.shiftright("key", KEY_BITS - bits).isin(sorted(open_at)))
        counted = cells.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("size")).collect()
        inside: dict[int | None, list[tuple[int, int]]] = {}
        for cell, size in sorted((r["cell"], r["size"]) for r in counted):
            inside.setdefault(None if None in open_at else cell >> (KEY_BITS - bits - shift), []).append((cell, size))
        still: dict[int | None, list[int]] = {}
        starts: dict[int | None, int] = {}
        for prefix, waiting in open_at.items():
            at = below[prefix]
            queue = list(waiting)
            for cell, size in inside[prefix]:
                while queue and at + size >= targets[queue[0]]:
                    k = queue.pop(0)
                    low, high = targets[k] - at, at + size - targets[k]
                    if min(low, high) <= allowed or shift == 0:
                        found[k] = (cell if low <= high else cell + 1) << shift
                    else:
                        still.setdefault(cell, []).append(k)
                        starts[cell] = at
                at += size
            for k in queue:  # targets at the very end
                found[k] = (inside[prefix][-1][0] + 1) << shift
        open_at, below, bits = still, starts, KEY_BITS - shift
    top = (1 << 63) - 1
    return [min(found.get(k, top), top) for k in range(n - 1)]


def part_of(key: Column, bounds: list[int], low: int = 0) -> Column:
    """Number of bounds at or below the key, by a tree of comparisons."""
    if not bounds:
        return F.lit(low)
    middle = len(bounds) // 2
    return F.when(key < F.lit(bounds[middle]), part_of(key, bounds[:middle], low)).otherwise(
        part_of(key, bounds[middle + 1 :], low + middle + 1)
    )


def shard_by_bytes(docs: DataFrame, shards: int = 24, ranges: int = 8, tolerance: float = 0.001) -> DataFrame:
    """Rows dealt to `shards` shards of near equal bytes: law `bytes`.

    Columns: doc_id, size, text_crc32, law, shard (0 to shards - 1), slot (from 0, without gaps,
    within a shard, in key order), grown_shard (null: only the law `key` has it). Each shard is cut
    into `ranges` key ranges, which tasks sort on their own; the rows before a range come from exact
    counts. Near equal: boundaries miss their targets by `tolerance` of a shard's bytes, or by the
    rows of a single key, that is, of one doc_id with one text.

    A null text has no bytes (size 8, crc32 0); a null doc_id is a value like others; equal texts lie
    side by side and are cut only between documents; repeated rows share a key and a shard. One text
    of any length stays whole, so a shard is never smaller than its largest row. An empty table
    gives an empty one; other columns are not read.
    """
    rows = stored(sized(docs), "histogram-sort")
    cut = splitters(rows, shards * ranges, tolerance)
    ranged = rows.withColumn("range", part_of(F.col("key"), cut))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        ranged.groupBy("range").count()
        .withColumn("shard", F.floor(F.col("range") / ranges).cast("int"))
        .select(F.col("range").alias("r"), "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    inner = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    placed = ranged.withColumn("number", F.row_number().over(inner))
    # One row per range, at most shards * ranges of them.
    return placed.join(F.broadcast(counts), F.col("range") == F.col("r")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("number") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
