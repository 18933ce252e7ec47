"""Comma and tab separated files: ragged reading, sniffing and writing."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk")
# Marks of UTF-16, and how files of markup begin.
UTF16_MARKS = (b"\xff\xfe", b"\xfe\xff")
MARKUP = ("<!doctype html", "<html", "<?xml")
ROWS_PER_BATCH = 20_000


def delimited_cells(files: DataFrame, sep: str | None = None, encoding: str = "utf-8-sig") -> DataFrame:
    """(path, row from 1, cells) of files given as (path, content); ragged rows stay ragged.

    Without `sep`, `.tsv` files are tab separated and all others comma separated. A file that is
    not text in the encoding yields one row with `error`.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"unsupported encoding: {encoding}")

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        csv.field_size_limit(sys.maxsize)  # cells of any length
        delimiter = sep or ("\t" if path.lower().endswith(".tsv") else ",")
        text = io.TextIOWrapper(io.BytesIO(content), encoding=encoding, newline="")
        try:
            for number, cells in enumerate(csv.reader(text, delimiter=delimiter), start=1):
                yield path, number, cells, None
        except (UnicodeDecodeError, csv.Error) as exc:
            yield path, None, None, str(exc)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "row", "cells", "error"]
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for row in rows_of(path, content):
                    held.append(row)
                    if len(held) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(held, columns=names).astype({"row": "Int64"})
                        held = []
        yield pd.DataFrame(held, columns=names).astype({"row": "Int64"})

    schema = "path string, row long, cells array<string>, error string"
    return files.select("path", "content").mapInPandas(read, schema)


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8-sig"
) -> DataFrame:
    """Cells of all files under a path. A file is read whole; `read_rectangular` splits large ones."""
    return delimited_cells(spark.read.format("binaryFile").load(path), sep, encoding)


def _allow(spark: SparkSession, encoding: str) -> None:
    if encoding not in ENCODINGS:
        raise ValueError(f"unsupported encoding: {encoding}")
    if encoding.startswith("gb"):
        # Spark's own list of CSV charsets leaves out the Chinese ones that Java knows.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_rectangular(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", encoding: str = "utf-8"
) -> DataFrame:
    """Files of any size with a known number of columns; Spark splits them across tasks."""
    _allow(spark, encoding)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("sep", sep).option("encoding", encoding)
    return reader.option("quote", '"').option("escape", '"').csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", encoding: str = "utf-8") -> None:
    """Write without a header; null becomes an empty cell."""
    _allow(df.sparkSession, encoding)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    charset = "utf-8" if encoding == "utf-8-sig" else encoding
    (
        df.select(*texts)
        .write.mode("overwrite")
        .option("sep", sep)
        .option("encoding", charset)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    """Text of bytes that are no UTF-8: UTF-16 if they start with its mark, else GB18030; null if neither."""

    def text(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else raw.decode("utf-16" if raw[:2] in UTF16_MARKS else "gb18030")
        except UnicodeDecodeError:
            return None

    return content.map(text)


def sniff_delimited(content: Column) -> Column:
    """struct(encoding, error) of a whole file: text of a known encoding, or why it is none."""
    wide = F.substring(content, 1, 2).isin(*[F.lit(mark) for mark in UTF16_MARKS])
    unicode = F.is_valid_utf8(content.cast("string")) & ~wide
    text = F.when(unicode, content.cast("string")).otherwise(_decoded(F.when(~unicode, content)))
    start = F.lower(F.regexp_replace(text, "^[\ufeff\r\n\t ]+", ""))
    markup = F.lit(False)
    for opening in MARKUP:
        markup = markup | start.startswith(opening)
    error = (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty")
        .when(~wide & F.contains(content, F.lit(b"\x00")), "binary")
        .when(text.isNull(), "undecodable")
        .when(start == "", "blank")
        .when(markup, "markup")
    )
    encoding = F.when(wide, "utf-16").when(unicode, "utf-8-sig").otherwise("gb18030")
    return F.struct(F.when(error.isNull(), encoding).alias("encoding"), error.alias("error"))
