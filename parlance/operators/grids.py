"""Cell grids in long form: path, sheet, row, col, value, formula, cached_value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.cells import (
    a1,
    formula_error,
    is_formula,
    is_risky_formula,
    parse_a1,
    parse_range,
)
from parlance.operators.ordered import cap_per_group, dedupe_first, exact_percentile

SHEET = ["path", "sheet"]
POSITION = [*SHEET, "row", "col"]
CELL_ORDER = ["sheet", "row", "col"]
REPORT_LIMIT = 100
#: Scales of up to so many groups are sent to all executors; those of more are joined by a shuffle.
BROADCAST_SCALES = 100_000


def _content() -> Column:
    """What the cell itself holds: its formula, else its value."""
    return F.coalesce(F.col("formula"), F.col("value"))


def sheet_profile(cells: DataFrame) -> DataFrame:
    """Rows, columns, formulas and literal errors per sheet."""
    return cells.groupBy(*SHEET).agg(
        F.max("row").alias("max_row"),
        F.max("col").alias("max_column"),
        F.count_if(is_formula(_content())).alias("formula_count"),
        F.count_if(formula_error(_content()).isNotNull()).alias("literal_error_count"),
    )


def error_locations(cells: DataFrame, n: int = REPORT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(the first n formula cells per path and cached error, total and truncated per error)."""
    failed = (
        cells.filter(is_formula(_content()))
        .withColumn("error", formula_error(F.col("cached_value")))
        .filter("error IS NOT NULL")
        .select(*POSITION, "error", a1(F.col("row"), F.col("col")).alias("cell"),
                _content().alias("formula"))
    )
    return cap_per_group(failed, ["path", "error"], CELL_ORDER, n)


def error_summary(cells: DataFrame) -> DataFrame:
    """Formulas, failed formulas, formulas without a cached value and status per path."""
    formula = is_formula(_content())
    error = formula_error(F.col("cached_value"))
    totals = cells.groupBy("path").agg(
        F.count_if(formula).alias("total_formulas"),
        F.count_if(formula & error.isNotNull()).alias("total_errors"),
        F.count_if(formula & F.col("cached_value").isNull()).alias("missing_cached_value_count"),
    )
    status = F.when(F.col("total_errors") == 0, "success").otherwise("errors_found")
    return totals.withColumn("status", status)


def risky_formulas(cells: DataFrame, n: int = REPORT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(the first n formulas per path that older programs cannot run, totals)."""
    risky = cells.filter(is_risky_formula(_content())).select(
        *POSITION, a1(F.col("row"), F.col("col")).alias("cell"), _content().alias("formula")
    )
    return cap_per_group(risky, ["path"], CELL_ORDER, n)


def delimited_profile(rows: DataFrame) -> DataFrame:
    """Rows and the widest row per file."""
    return rows.groupBy("path").agg(
        F.count("*").alias("row_count"), F.max(F.size("cells")).alias("max_column_count")
    )


def grid_viewport(
    cells: DataFrame, start_row: int, start_col: int, rows: int, cols: int
) -> tuple[DataFrame, DataFrame]:
    """(non-empty cells of a window in every sheet, next_row and next_column per sheet)."""
    last_row, last_col = start_row + rows - 1, start_col + cols - 1
    seen = cells.filter(
        F.col("row").between(start_row, last_row) & F.col("col").between(start_col, last_col)
    )
    error = formula_error(F.when(is_formula(_content()), F.col("cached_value")).otherwise(F.col("value")))
    seen = seen.filter(_content().isNotNull() | F.col("cached_value").isNotNull())
    seen = seen.withColumn("error", error)
    extent = cells.groupBy(*SHEET).agg(F.max("row").alias("_rows"), F.max("col").alias("_cols"))
    end_row = F.least(F.col("_rows"), F.lit(last_row))
    end_col = F.least(F.col("_cols"), F.lit(last_col))
    cursor = extent.select(
        *SHEET,
        end_row.alias("end_row"),
        end_col.alias("end_column"),
        F.when(end_row < F.col("_rows"), end_row + 1).alias("next_row"),
        F.when(end_col < F.col("_cols"), end_col + 1).alias("next_column"),
    )
    return seen, cursor


def rows_to_cells(rows: DataFrame) -> DataFrame:
    """Rows written from an anchor as cell writes.

    `rows` holds path, sheet, start_cell, offset (0 for the anchor's own row), values and seq.
    """
    at = rows.withColumn("_at", parse_a1(F.col("start_cell"))).filter("_at IS NOT NULL")
    cells = at.select(
        *SHEET, "seq", F.col("_at"), "offset", F.posexplode("values").alias("_i", "_v")
    )
    text = F.col("_v")
    return cells.select(
        *SHEET,
        (F.col("_at.row") + F.col("offset")).cast("int").alias("row"),
        (F.col("_at.col") + F.col("_i")).cast("int").alias("col"),
        F.when(~is_formula(text), text).alias("value"),
        F.when(is_formula(text), text).alias("formula"),
        "seq",
    )


def patch_errors(patch: DataFrame) -> DataFrame:
    """Writes that set both value and formula, or a formula without `=`."""
    both = F.col("value").isNotNull() & F.col("formula").isNotNull()
    bad = F.col("formula").isNotNull() & ~is_formula(F.col("formula"))
    error = F.when(both, "value_and_formula").when(bad, "formula_without_equals")
    return patch.withColumn("error", error).filter("error IS NOT NULL")


def upsert_cells(cells: DataFrame, patch: DataFrame) -> DataFrame:
    """Write cells: the last write by `seq` wins, and replaces value, formula and cached value."""
    both = F.col("value").isNotNull() & F.col("formula").isNotNull()
    bad = F.col("formula").isNotNull() & ~is_formula(F.col("formula"))
    last = dedupe_first(patch.filter(~both & ~bad), POSITION, [F.col("seq").desc()])
    written = last.select(
        *POSITION, "value", "formula", F.lit(None).cast("string").alias("cached_value")
    )
    kept = cells.join(written.select(*POSITION), POSITION, "left_anti")
    return kept.unionByName(written)


def append_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows (path, sheet, idx from 1, values) below the last used row of their sheet."""
    last = cells.groupBy(*SHEET).agg(F.max("row").alias("_last"))
    added = (
        rows.join(last, SHEET, "left")
        .withColumn("row", (F.coalesce("_last", F.lit(0)) + F.col("idx")).cast("int"))
        .select(*SHEET, "row", F.posexplode("values").alias("_i", "_v"))
        .select(
            *SHEET,
            "row",
            (F.col("_i") + 1).cast("int").alias("col"),
            F.when(~is_formula(F.col("_v")), F.col("_v")).alias("value"),
            F.when(is_formula(F.col("_v")), F.col("_v")).alias("formula"),
            F.lit(None).cast("string").alias("cached_value"),
        )
        .filter("value IS NOT NULL OR formula IS NOT NULL")
    )
    return cells.unionByName(added)


def clear_range(cells: DataFrame, reference: str) -> DataFrame:
    """Empty the cells of a rectangle in every sheet; the cells themselves stay."""
    box = parse_range(F.lit(reference))
    inside = (
        F.col("row").between(F.least(box["row"], box["end_row"]), F.greatest(box["row"], box["end_row"]))
        & F.col("col").between(F.least(box["col"], box["end_col"]), F.greatest(box["col"], box["end_col"]))
    )
    for name in ("value", "formula", "cached_value"):
        cells = cells.withColumn(name, F.when(~F.coalesce(inside, F.lit(False)), F.col(name)))
    return cells


def shift_rows(
    cells: DataFrame, index: int, amount: int = 1, axis: str = "row", delete: bool = False
) -> DataFrame:
    """Insert or delete rows (or columns, with axis `col`); formulas keep their text."""
    if index < 1 or not 1 <= amount <= 10_000:
        raise ValueError("index must be positive and amount between 1 and 10000")
    at = F.col(axis)
    if delete:
        kept = cells.filter(~at.between(index, index + amount - 1))
        return kept.withColumn(axis, F.when(at >= index + amount, at - amount).otherwise(at))
    return cells.withColumn(axis, F.when(at >= index, at + amount).otherwise(at))


def _compared(value: Column, operator: str, low, high) -> Column:
    a = F.lit(low)
    tests = {
        "equal": lambda: value == a,
        "notEqual": lambda: value != a,
        "greaterThan": lambda: value > a,
        "lessThan": lambda: value < a,
        "greaterThanOrEqual": lambda: value >= a,
        "lessThanOrEqual": lambda: value <= a,
        "between": lambda: value.between(a, F.lit(high)),
        "notBetween": lambda: ~value.between(a, F.lit(high)),
    }
    return tests[operator]()


def cell_flag(col: Column, operator: str, low, high=None) -> Column:
    """Conditional-format test of a cell against one bound or two."""
    return F.coalesce(_compared(col, operator, low, high), F.lit(False))


def rule_violated(col: Column, rule: dict) -> Column:
    """True where the text of a cell breaks a validation rule.

    A rule has `kind` (list, whole, decimal, date, time, textLength), `operator`, `low`, `high`,
    or `values` for a list, and `allow_blank` (default true).
    """
    kind = rule["kind"]
    operator = rule.get("operator", "between")
    text = col.cast("string")
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    if kind == "list":
        good = text.isin(*rule["values"])
    elif kind == "textLength":
        good = _compared(F.length(text), operator, rule["low"], rule.get("high"))
    else:
        number = text.try_cast("double")
        if kind == "whole":
            number = F.when(number == F.floor(number), number)
        elif kind == "date":
            number = text.try_cast("date")
        elif kind == "time":
            clock = F.when(text.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"), F.split(text, ":"))
            number = (
                F.get(clock, F.lit(0)).cast("int") * 3600
                + F.get(clock, F.lit(1)).cast("int") * 60
                + F.coalesce(F.get(clock, F.lit(2)), F.lit("0")).cast("int")
            )
        good = _compared(number, operator, rule["low"], rule.get("high"))
    allowed_blank = F.lit(rule.get("allow_blank", True))
    return F.when(blank, ~allowed_blank).otherwise(~F.coalesce(good, F.lit(False)))


def check_rules(df: DataFrame, keys: Sequence[str], rules: Sequence[dict]) -> DataFrame:
    """Violations as (keys, rule, column, value), one pass over the table for all rules."""
    found = F.array(
        *[
            F.when(
                rule_violated(F.col(rule["column"]), rule),
                F.struct(
                    F.lit(rule["name"]).alias("rule"),
                    F.lit(rule["column"]).alias("column"),
                    F.col(rule["column"]).cast("string").alias("value"),
                ),
            )
            for rule in rules
        ]
    )
    return df.select(*keys, F.explode(F.array_compact(found)).alias("_v")).select(*keys, "_v.*")


def scale_point(value: Column) -> Column:
    """Place of a value on the scale `lowest`, `percentile` (the median), `highest`; null for a null value."""
    value = value.cast("double")
    low, mid, high = F.col("lowest"), F.col("percentile"), F.col("highest")
    lower = F.when(mid > low, (value - low) / (mid - low) * 0.5).otherwise(0.5)
    upper = F.when(high > mid, 0.5 + (value - mid) / (high - mid) * 0.5).otherwise(0.5)
    position = F.when(high == low, F.when(value.isNotNull(), 0.0)).when(value <= mid, lower)
    return F.when(value.isNotNull(), position.otherwise(upper))


def scale_position(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Position of each value on a three-colour scale: 0 at the minimum, 0.5 at the median, 1 at
    the maximum, linear in between; null for a null value. Null keys are a group like any other."""
    group = F.struct(*[F.col(k) for k in keys])
    rows = df.withColumn("_group", group)
    scale = exact_percentile(rows.select("_group", col), ["_group"], col, 0.5).drop("n")
    # Rows of few groups are not shuffled: that would send all of a group to one task.
    few = rows.select("_group").distinct().limit(BROADCAST_SCALES + 1).count() <= BROADCAST_SCALES
    placed = rows.join(F.broadcast(scale) if few else scale, "_group", "left")
    return placed.withColumn("position", scale_point(F.col(col))).drop("_group")
