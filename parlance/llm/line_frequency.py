"""Quality rules with the frequency of lines across the documents of a host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import SPACE, arrow_rows, raw, stored

SYMBOLS = b"#*$%&|<>"
DIGITS = bytes.maketrans(b"0123456789", b"0" * 10)
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more in the text, first ones included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    if len(numbers) <= 1 << 12:
        windows = sum(ids[k : k + n] << (12 * k) for k in range(WINDOW))
    else:  # ranks of pairs, then of fours, keep the codes exact and within 64 bits
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
        fours = np.unique(pairs[:-2] * (int(pairs.max()) + 1) + pairs[2:], return_inverse=True)[1]
        windows = fours[:n] * len(numbers) + ids[WINDOW - 1 :]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, np.int64)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:n] += twice[:n]
    covered[WINDOW:] -= twice[:n]
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """Counts of one text, and hash and words of its normalised lines, each distinct line once.

    A normalised line is in lower case, with one space between words and digits as 0.
    """
    words = text.split()
    joined = text.translate(None, SPACE)
    chars = len(joined) - (len(joined) - len(joined.translate(None, CONTINUATION)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    duplicates = 0
    lines: dict[int, int] = {}
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        duplicates += line in seen
        seen.add(line)
        normal = b" ".join(line.decode(errors="replace").lower().encode().translate(DIGITS).split())
        key = xxhash.xxh3_64_intdigest(normal) - (1 << 63)
        lines[key] = lines.get(key, 0) + len(own)
    return len(words), chars, symbols, duplicates, repeated_words(words), list(lines), list(lines.values())


def line_frequency_rules(
    docs: DataFrame,
    host: str = "source",
    max_docs: int = 10,
    min_kept: float = 0.5,
    min_words: int = 10,
    max_repeat: float = 0.2,
) -> DataFrame:
    """Word counts, base rules and the verdict of the line-frequency rule, one row per input row.

    A normalised line that occurs in more than `max_docs` documents (distinct doc_ids) of one host is
    removed from all of them but the first (smallest doc_id). A document of which less than
    `min_kept` of its words is left is depleted and rejected. Base rules come first: fewer than
    `min_words` words, or more than `max_repeat` of them in repeated windows of five, reject it.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    removed_words. A null text has no words and fails; a null host is a host of its own; documents
    with a null doc_id count as one; repeated rows are judged one by one and count as one document.
    Very long texts are read whole. An empty table gives an empty one; other columns are not read.
    """
    kinds = (
        "row long, host string, doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, line array<long>, words array<long>"
    )
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema(
        [("row", pa.int64()), ("host", pa.string()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in longs),
         ("line", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text.as_py() or b"") for text in batch.column(3)]
            columns = list(map(list, zip(*rows))) or [[]] * 7
            yield arrow_rows(schema, [batch.column(0), batch.column(1), batch.column(2), *columns])

    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(host).cast("string").alias("host"),
        F.col("doc_id").cast("long").alias("doc_id"),
        raw(),
    )
    measured = stored(slim.mapInArrow(run, kinds), "line-frequency")
    lines = measured.select("row", "host", "doc_id", F.explode(F.arrays_zip("line", "words")).alias("l"))
    lines = lines.select("row", "host", "doc_id", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    frequent = (
        lines.groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.sum("one").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("n_docs") > max_docs)
        .select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), "first_doc")
    )
    removed = (
        lines.join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")))
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("removed_words"))
    )
    judged = measured.join(removed, F.col("row") == F.col("r"), "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > F.lit(round(100 * max_repeat)) * F.col("n_words"))
    enough = (F.col("n_words") - F.col("removed_words")) >= F.lit(min_kept) * F.col("n_words")
    return judged.select(
        "doc_id", *longs, failed.alias("base_failed"), (~failed & enough).alias("kept"), "removed_words"
    )
