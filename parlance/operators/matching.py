"""Joins on text and place that never pair up whole groups.

One side of these joins comes out of an explode, whose size Spark's estimates do not see, so
hints keep it from being broadcast: a hash join over shuffled data builds on the side with
distinct keys, and where no side has distinct keys both are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CHUNK = 256


def grams(text: Column, sizes: Column) -> Column:
    """Distinct substrings of the text whose length is one of `sizes`.

    Finding a position in a string means walking to it, so long texts are first cut into chunks
    that overlap by the longest size, and substrings are taken from the chunks.
    """
    chunks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(CHUNK)),
        lambda start: F.substring(text, start, F.array_max(sizes) + (CHUNK - 1)),
    )

    def of(chunk: Column) -> Column:
        fitting = F.filter(sizes, lambda n: n <= F.length(chunk))
        cut = F.transform(
            fitting,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.least(F.length(chunk) - n + 1, F.lit(CHUNK))),
                lambda i: F.substring(chunk, i, n),
            ),
        )
        return F.flatten(cut)

    return F.array_distinct(F.flatten(F.transform(chunks, of)))


def containing(
    needles: DataFrame, haystack: DataFrame, keys: Sequence[str], needle: str, texts: Sequence[str],
    whole: int | None = None,
) -> DataFrame:
    """Haystack rows with each needle of their group that one of their texts contains.

    Substring containment as an equi-join: every text is cut into substrings of the lengths its
    group's needles have, and joined on group and substring. The work is linear in the haystack,
    and only true matches leave the join. With `whole`, longer needles are looked up by their
    first `whole` characters and checked in full afterwards.
    """
    probe = F.col(needle) if whole is None else F.left(F.col(needle), F.lit(whole))
    wanted = needles.select(*keys, needle).distinct().withColumn("_probe", probe)
    sizes = wanted.groupBy(*keys).agg(F.collect_set(F.length("_probe")).alias("_sizes"))
    pieces = haystack.join(sizes, list(keys)).withColumn(
        "_probe",
        F.explode(
            F.array_distinct(
                F.concat(*[grams(F.coalesce(F.col(t), F.lit("")), F.col("_sizes")) for t in texts])
            )
        ),
    )
    hits = pieces.join(wanted.hint("shuffle_hash"), [*keys, "_probe"])
    if whole is not None:
        test = F.lit(False)
        for t in texts:
            test = test | F.coalesce(F.contains(F.col(t), F.col(needle)), F.lit(False))
        hits = hits.filter(test)
    return hits.drop("_sizes", "_probe")


GRID = 32


def grid_cell(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value * GRID), F.lit(0)), F.lit(GRID - 1)).cast("int")


def with_cells(boxes: DataFrame, pad: float) -> DataFrame:
    """One row per distinct box and grid cell it may hold points of."""
    across = F.sequence(grid_cell(F.col("x0") - pad), grid_cell(F.col("x1") + pad))
    down = F.sequence(grid_cell(F.col("y0") - pad), grid_cell(F.col("y1") + pad))
    return boxes.distinct().withColumn("_gx", F.explode(across)).withColumn("_gy", F.explode(down))


def _inside(x: Column, y: Column, pad: float) -> Column:
    return (
        (x >= F.col("x0") - pad)
        & (x <= F.col("x1") + pad)
        & (y >= F.col("y0") - pad)
        & (y <= F.col("y1") + pad)
    )


def _covers(pad: float) -> Column:
    """The padded box holds every point of its grid cell."""
    return (
        (F.col("x0") - pad <= F.col("_gx") / GRID)
        & (F.col("x1") + pad >= (F.col("_gx") + 1) / GRID)
        & (F.col("y0") - pad <= F.col("_gy") / GRID)
        & (F.col("y1") + pad >= (F.col("_gy") + 1) / GRID)
    )


def in_any_box(
    lines: DataFrame, boxes: DataFrame, keys: Sequence[str], pad: float = 0.005,
    inside: bool = True,
) -> DataFrame:
    """Lines whose centre (`cx`, `cy`) lies in any box of their page, or in none of them.

    Points and boxes meet in the cells of a 32 x 32 grid. A cell that one box covers entirely is
    settled by a plain semi-join, so overlapping large boxes cost nothing extra; only the cells on
    box edges are compared point by box.
    """
    placed = lines.withColumn("_gx", grid_cell(F.col("cx"))).withColumn("_gy", grid_cell(F.col("cy")))
    on_page = (
        (F.col("cx") >= 0) & (F.col("cx") <= 1) & (F.col("cy") >= 0) & (F.col("cy") <= 1)
    )
    cells = with_cells(boxes.select(*keys, "x0", "y0", "x1", "y1"), pad)
    cell_keys = [*keys, "_gx", "_gy"]
    full = cells.filter(_covers(pad)).select(*cell_keys).distinct()
    edges = cells.filter(~_covers(pad)).join(full.hint("shuffle_hash"), cell_keys, "left_anti")
    settled = placed.withColumn("_page", on_page)
    full = full.withColumn("_full", F.lit(True))
    marked = (
        settled.join(full.hint("shuffle_hash"), cell_keys, "left")
        .withColumn("_sure", F.coalesce(F.col("_full") & F.col("_page"), F.lit(False)))
        .drop("_full")
    )
    # Points beside the page fall into border cells, where full boxes still need the exact test.
    exact = edges.unionByName(
        cells.filter(_covers(pad)).filter(
            F.col("_gx").isin(0, GRID - 1) | F.col("_gy").isin(0, GRID - 1)
        )
    )
    spots = exact.select(
        *[F.col(k).alias(f"_b{k}") for k in cell_keys], "x0", "y0", "x1", "y1"
    ).hint("merge")
    test = _inside(marked["cx"], marked["cy"], pad)
    for k in cell_keys:
        test = test & (marked[k] == spots[f"_b{k}"])
    if inside:
        hits = marked.join(spots, test, "left_semi")
        return (
            marked.filter("_sure")
            .unionByName(hits.filter("NOT _sure"))
            .select(*lines.columns)
        )
    rest = marked.filter("NOT _sure")
    return rest.join(spots, test, "left_anti").select(*lines.columns)
