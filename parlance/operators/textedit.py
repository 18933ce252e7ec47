"""Literal edits over numbered paragraphs (doc_id, pos, text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import literal_pattern
from parlance.operators.ordered import cap_per_group, first_rows

MAX_REPLACEMENTS = 10_000
AFFECTED_LIMIT = 100


def _literal_replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def replace_literal(
    paragraphs: DataFrame, find: str, replacement: str, match_case: bool = True,
    whole_word: bool = False, count: int = 0,
) -> DataFrame:
    """Replace a literal text; adds `replaced`, the matches replaced in each paragraph.

    `count` limits the replacements per document, in paragraph order; 0 means no limit. Only
    paragraphs with matches, and at most `count` of them per document, enter the ordered part.
    """
    if not find:
        raise ValueError("nothing to find")
    if not 0 <= count <= MAX_REPLACEMENTS:
        raise ValueError(f"count must be between 0 and {MAX_REPLACEMENTS}")
    pattern = literal_pattern(find, match_case, whole_word)
    found = F.regexp_count("text", F.lit(pattern))
    new = _literal_replacement(replacement)
    if count == 0:
        return paragraphs.withColumn("replaced", found).withColumn(
            "text", F.regexp_replace("text", pattern, new)
        )
    hits = paragraphs.select("doc_id", "pos", found.alias("_found")).filter("_found > 0")
    hits = first_rows(hits, ["doc_id"], ["pos"], count)
    before = (
        Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.lit(count) - F.coalesce(F.sum("_found").over(before), F.lit(0))
    hits = hits.withColumn("_take", F.greatest(F.lit(0), F.least("_found", left)).cast("int"))
    hits = hits.filter("_take > 0").select("doc_id", "pos", "_take")
    rows = paragraphs.join(hits, ["doc_id", "pos"], "left")
    take = F.coalesce("_take", F.lit(0))
    # Splitting into take + 1 pieces cuts at exactly the first `take` matches.
    pieces = F.split(F.col("text"), pattern, take + 1)
    edited = F.when(take > 0, F.array_join(pieces, replacement)).otherwise(F.col("text"))
    return rows.withColumn("text", edited).withColumn("replaced", take).drop("_take")


def affected_paragraphs(
    replaced: DataFrame, n: int = AFFECTED_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """(the first n changed positions per document, replacements and changed paragraphs)."""
    changed = replaced.filter("replaced > 0").select("doc_id", "pos", "replaced")
    kept, _ = cap_per_group(changed, ["doc_id"], ["pos"], n)
    totals = changed.groupBy("doc_id").agg(
        F.sum("replaced").alias("replacement_count"), F.count("*").alias("paragraphs")
    )
    return kept.drop("replaced"), totals


def matches(text: Column, wanted: str, mode: str) -> Column:
    """Exact or contains test of a paragraph."""
    if not wanted or mode not in ("exact", "contains"):
        raise ValueError("a text and the mode exact or contains are needed")
    return text == wanted if mode == "exact" else F.contains(text, F.lit(wanted))


def _first_matches(paragraphs: DataFrame, test: Column, n: int) -> DataFrame:
    return first_rows(paragraphs.filter(test).select("doc_id", "pos"), ["doc_id"], ["pos"], n)


def remove_matching(
    paragraphs: DataFrame, text: str, mode: str = "contains", n: int = 0
) -> DataFrame:
    """Remove matching paragraphs, only the first n per document if n is positive."""
    test = F.coalesce(matches(F.col("text"), text, mode), F.lit(False))
    if n == 0:
        return paragraphs.filter(~test)
    return paragraphs.join(_first_matches(paragraphs, test, n), ["doc_id", "pos"], "left_anti")


def label_matching(paragraphs: DataFrame, text: str, label: str, column: str = "style") -> DataFrame:
    """Set a label on every paragraph that contains the text."""
    test = F.coalesce(matches(F.col("text"), text, "contains"), F.lit(False))
    old = F.col(column) if column in paragraphs.columns else F.lit(None).cast("string")
    return paragraphs.withColumn(column, F.when(test, F.lit(label)).otherwise(old))


def insert_after(
    paragraphs: DataFrame, anchor: str, blocks: list[str], mode: str = "contains"
) -> DataFrame:
    """Insert blocks after the first matching paragraph of each document and renumber.

    Positions after the anchor move by the number of blocks; documents without it stay as they are.
    """
    anchors = paragraphs.filter(matches(F.col("text"), anchor, mode)).groupBy("doc_id").agg(
        F.min("pos").alias("_anchor")
    )
    moved = paragraphs.join(anchors, "doc_id", "left").withColumn(
        "pos",
        F.when(F.col("pos") > F.col("_anchor"), F.col("pos") + len(blocks))
        .otherwise(F.col("pos"))
        .cast("int"),
    )
    items = F.posexplode(F.array(*[F.lit(block) for block in blocks])).alias("_i", "text")
    added = anchors.select("doc_id", "_anchor", items).select(
        "doc_id", (F.col("_anchor") + 1 + F.col("_i")).cast("int").alias("pos"), "text"
    )
    return moved.drop("_anchor").unionByName(added, allowMissingColumns=True)
