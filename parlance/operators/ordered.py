"""Ordered operators that keep working when one key holds a large share of all rows.

A window over a whole key would sort that key in one task. `running_total` instead splits every
key into consecutive buckets: bucket totals are pre-aggregated before their shuffle, the start of
each bucket is a running sum over those few totals, and only rows of one bucket are sorted
together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column | None = None,
    out: str = "seq",
) -> DataFrame:
    """Running sum of `value` (running row count without it) per key, including the row itself.

    `order` must be unique per key. `bucket` must not decrease along it and should hold a bounded
    number of rows: `pos DIV 4096` for positions, a minute for message times.
    """
    amount = F.lit(1).cast("long") if value is None else value
    # One struct as join and window key: null keys match each other, and the rows that the join
    # has already partitioned by it need no second shuffle for the window.
    part = F.struct(*[F.col(k) for k in keys], bucket.alias("_bucket"))
    rows = df.withColumn("_part", part).withColumn("_amount", amount)
    totals = rows.groupBy("_part").agg(F.sum("_amount").alias("_total"))
    per_key = Window.partitionBy(*[f"_part.{k}" for k in keys])
    earlier = per_key.orderBy("_part._bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"),
    )
    inside = (
        Window.partitionBy("_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(starts, "_part")
        .withColumn(out, F.col("_start") + F.sum("_amount").over(inside))
        .select(*df.columns, out)
    )


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key. The rank limit is applied before the shuffle, once per input task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, rank: str = "_rank"
) -> DataFrame:
    """The first n rows of each key; at most n rows per key and input task are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return out.drop(rank) if rank == "_rank" else out


def cap_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int
) -> tuple[DataFrame, DataFrame]:
    """(the first n rows per key with their `rank`, total and truncated remainder per key)."""
    kept = first_rows(df, keys, order, n, rank="rank")
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return kept, totals.withColumn("truncated", F.greatest(F.lit(0), F.col("total") - n))


def missing_names(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required names that are not present, null equal to null."""
    have = present.select(*[F.col(k).alias(f"_have_{k}") for k in keys]).distinct()
    test = F.lit(True)
    for k in keys:
        test = test & required[k].eqNullSafe(have[f"_have_{k}"])
    return required.join(have, test, "left_anti")


def _cumulative(keys: Sequence[str], by: str) -> Column:
    """Sum of `_total` over the earlier values of `by`."""
    earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_total").over(earlier), F.lit(0))


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, fraction: float) -> DataFrame:
    """Exact linear-interpolation percentile per key without holding a key in one task.

    Two histograms close in on the wanted ranks: logarithmic bins cope with any spread, linear
    bins inside the bin found cope with crowded values. Only the distinct values of the final bin
    are ordered, and equal values are counted before anything is shuffled by bin.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_count"))
    scale = F.signum("_v") * F.floor(F.ln(1 + F.abs("_v")) * 256)
    coarse = counts.withColumn("_coarse", scale)
    bins = coarse.groupBy(*keys, "_coarse").agg(
        F.sum("_count").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    whole = Window.partitionBy(*keys)
    bins = (
        bins.withColumn("_start", _cumulative(keys, "_coarse"))
        .withColumn("n", F.sum("_total").over(whole))
        .withColumn("lowest", F.min("_lo").over(whole))
        .withColumn("highest", F.max("_hi").over(whole))
    )
    # Ranks count from 0: the percentile lies between the ranks floor(at) and ceil(at).
    at = (F.col("n") - 1) * F.lit(fraction)
    hit = (F.ceil(at) >= F.col("_start")) & (F.floor(at) < F.col("_start") + F.col("_total"))
    found = bins.filter(hit).drop("_total")
    width = F.col("_hi") - F.col("_lo")
    share = F.floor((F.col("_v") - F.col("_lo")) / width * 4096)
    fine = coarse.join(found, [*keys, "_coarse"]).withColumn(
        "_fine", F.when(width > 0, share).otherwise(0)
    )
    kept = [*keys, "_coarse", "_start", "n", "lowest", "highest"]
    steps = fine.groupBy(*kept, "_fine").agg(F.sum("_count").alias("_total"))
    inside = _cumulative([*keys, "_coarse"], "_fine")
    steps = steps.withColumn("_start", F.col("_start") + inside).filter(hit).drop("_total")
    running = (
        Window.partitionBy(*keys, "_coarse", "_fine")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    values = fine.select(*keys, "_coarse", "_fine", "_v", "_count")
    ranked = (
        values.join(steps, [*keys, "_coarse", "_fine"])
        .withColumn("_end", F.col("_start") + F.sum("_count").over(running))
        .withColumn("_first", F.col("_end") - F.col("_count"))
    )

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_end")), F.col("_v")))

    picked = ranked.groupBy(*keys).agg(
        F.max("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.max("n").alias("n"),
        at_rank(F.floor(at)).alias("_below"),
        at_rank(F.ceil(at)).alias("_above"),
    )
    step = (F.col("_above") - F.col("_below")) * (at - F.floor(at))
    return picked.select(
        *keys, "lowest", (F.col("_below") + step).alias("percentile"), "highest", "n"
    )
