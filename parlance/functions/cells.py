"""Spreadsheet references, formulas and value typing as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import strip

# Formula error codes.
FORMULA_ERRORS = (
    "#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A",
    "#GETTING_DATA", "#SPILL!", "#CALC!", "#FIELD!", "#BLOCKED!", "#UNKNOWN!",
)
# Fixed value: functions that older spreadsheet programs lack.
RISKY_FORMULA = r"(?i)\b(?:XLOOKUP|XMATCH|SORT|FILTER|UNIQUE|SEQUENCE)\s*\("

CELL = r"^([A-Z]{1,3})([1-9][0-9]{0,6})$"
CELL_OR_RANGE = r"^([A-Z]{1,3})([1-9][0-9]{0,6})(?::([A-Z]{1,3})([1-9][0-9]{0,6}))?$"

INTEGER = r"^[+-]?\d+(_\d+)*$"
DECIMAL = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
INFINITY = r"(?i)^[+-]?inf(inity)?$"
NOT_A_NUMBER = r"(?i)^[+-]?nan$"


def is_formula(col: Column) -> Column:
    return F.coalesce(col.startswith("="), F.lit(False))


def formula_error(col: Column) -> Column:
    """The normalized error code, or null."""
    code = F.upper(strip(col))
    return F.when(code.isin(*FORMULA_ERRORS), code)


def is_risky_formula(col: Column) -> Column:
    return is_formula(col) & F.coalesce(col.rlike(RISKY_FORMULA), F.lit(False))


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""

    def place(offset: int) -> Column:
        at = F.length(letters) - offset
        code = F.ascii(F.substring(letters, at, F.lit(1))) - 64
        return F.when(at >= 1, code * 26**offset).otherwise(0)

    return place(0) + place(1) + place(2)


def column_letters(number: Column) -> Column:
    """A for 1, AA for 27."""
    one = F.char((number - 1) % 26 + 65)
    rest = F.floor((number - 1) / 26).cast("int")
    two = F.when(rest > 0, F.char((rest - 1) % 26 + 65)).otherwise(F.lit(""))
    more = F.floor((rest - 1) / 26).cast("int")
    three = F.when(more > 0, F.char((more - 1) % 26 + 65)).otherwise(F.lit(""))
    return F.concat(three, two, one)


def a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def parse_a1(col: Column) -> Column:
    """Cell reference as struct(row, col); null when it is no reference."""
    text = F.upper(strip(col))
    return F.when(
        text.rlike(CELL),
        F.struct(
            F.regexp_extract(text, CELL, 2).try_cast("int").alias("row"),
            column_number(F.regexp_extract(text, CELL, 1)).alias("col"),
        ),
    )


def _once(col: Column, build: Callable[[Column], Column]) -> Column:
    """`build` of a value that it names several times, worked out once a row."""
    return F.get(F.transform(F.array(col), build), F.lit(0))


def parse_range(col: Column) -> Column:
    """Cell or range reference, `$` ignored, as struct(row, col, end_row, end_col), else null."""

    def corners(text: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(text, CELL_OR_RANGE, i)

        def pair(first: int, name: str, read: Callable[[Column], Column]) -> Column:
            second = F.when(text.contains(":"), part(first + 2)).otherwise(part(first))
            return F.struct(_once(part(first), read).alias(name), _once(second, read).alias(f"end_{name}"))

        def box(rows: Column, cols: Column) -> Column:
            return F.struct(rows["row"].alias("row"), cols["col"].alias("col"), rows["end_row"].alias("end_row"), cols["end_col"].alias("end_col"))

        rows, cols = pair(2, "row", lambda x: x.try_cast("int")), pair(1, "col", column_number)
        return F.when(text.rlike(CELL_OR_RANGE), box(rows, cols))

    return _once(F.upper(strip(F.replace(col, F.lit("$"), F.lit("")))), corners)


def coerce_cell(col: Column) -> Column:
    """Type a delimited cell: struct(kind, b, i, d, s).

    A number with a leading zero and no point is not an integer but still a float, so `007` is 7.0.
    Integers beyond 64 bits keep their text under the kind `bigint`.
    """
    text = strip(col)
    word = F.lower(text)
    plain = F.replace(text, F.lit("_"), F.lit(""))
    padded = ~text.contains(".") & (
        (text.startswith("0") & (F.length(text) > 1))
        | (text.startswith("-0") & (F.length(text) > 2))
    )
    whole = text.rlike(INTEGER) & ~padded
    number = plain.try_cast("bigint")
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    floating = (
        F.when(text.rlike(DECIMAL), plain.try_cast("double"))
        .when(text.rlike(INFINITY), sign * F.lit(float("inf")))
        .when(text.rlike(NOT_A_NUMBER), F.lit(float("nan")))
    )
    kind = (
        F.when(text == "", "blank")
        .when(word.isin("true", "false"), "bool")
        .when(whole & number.isNotNull(), "int")
        .when(whole, "bigint")
        .when(floating.isNotNull(), "float")
        .otherwise("text")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "bool", word == "true").alias("b"),
        F.when(kind == "int", number).alias("i"),
        F.when(kind == "float", floating).alias("d"),
        F.when(kind.isin("text", "bigint"), F.when(kind == "text", col).otherwise(text))
        .when(kind == "blank", F.lit(""))
        .alias("s"),
    )
