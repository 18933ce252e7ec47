"""Token counts of the sections of a text, from one encoding of the whole text.

Encoding sections on their own gives other tokens than they have in the document. So the document is
encoded once; the spans of its tokens and of its sections are joined as intervals, and a token that
reaches over a boundary is allotted by a stated rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.byte_transducer import Transducer
from parlance.llm.common import arrow_rows

#: How a token that reaches over a boundary is allotted: to the section of its first or last
#: character, or to the one that holds most of its characters (the earlier one of equals).
RULES = ("first", "last", "most")

#: The library's splitter overflows its stack in runs of white space of about a million characters; texts with runs
#: from this length on are split and encoded by the byte transducer, which gives the same ids in linear time.
LONG_SPACE = 100_000

_ENCODERS: dict[tuple[str, int], object] = {}


def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    key = (pattern, hash(ranks))
    if key not in _ENCODERS:
        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            lengths[rank] = len(token)
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        _ENCODERS[key] = _Encoder(coder, table, pattern), lengths
    return _ENCODERS[key]


class _Encoder:
    """The library's encoder, and a second one that texts with very long white space need."""

    def __init__(self, library, ranks: dict[bytes, int], pattern: str):
        import regex

        self.library, self.ranks = library, ranks
        self.split = regex.compile(pattern)
        self.spaces = regex.compile(rf"\s{{{LONG_SPACE}}}")
        self.machine: Transducer | None = None

    def encode_ordinary(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE or not self.spaces.search(text):
            return self.library.encode_ordinary(text)
        if self.machine is None:
            self.machine = Transducer(self.ranks)
        return self.machine.encode(self.split.findall(text))


def token_spans(text: str, encoder) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token; a token that holds a part of a character spans it."""
    coder, lengths = encoder
    ids = np.asarray(coder.encode_ordinary(text), np.int64)
    ends = np.cumsum(lengths[ids])
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return ends - lengths[ids], ends
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters that begin before each byte
    starts = ends - lengths[ids]
    inside = (data[starts] & 0xC0) == 0x80 if len(ids) else np.zeros(0, bool)
    return heads[starts] - inside, heads[ends]


def line_bounds(text: str) -> np.ndarray:
    """Start of each line and the end of the text; a line holds its line feed, so that lines fill the text."""
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    return np.concatenate(([0], feeds[feeds < len(text)], [len(text)]))


def allot(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, crossing tokens and characters of tokens of each interval [bounds[i], bounds[i + 1]).

    Crossing: tokens that reach into the interval and out of it. Tokens outside of all intervals
    count nowhere. The last array is the number of tokens when a crossing one is shared by characters.
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    inner = first == last
    chosen = first.copy() if rule != "last" else last.copy()
    share = np.bincount(np.clip(first[inner], 0, n), minlength=n + 1).astype(float)
    crossing = np.zeros(n + 1, np.int64)
    for k in np.flatnonzero(~inner):
        own = np.arange(first[k], last[k] + 1)
        low = np.maximum(starts[k], np.where(own >= 0, bounds[own], 0))
        high = np.minimum(ends[k], np.where(own < n, bounds[np.minimum(own + 1, n)], ends[k]))
        held = high - low
        if rule == "most":
            chosen[k] = own[np.argmax(held)]
        crossing[own] += 1
        share[own] += held / held.sum()
    counts = np.bincount(chosen[(chosen >= 0) & (chosen < n)], minlength=n)
    return counts[:n], crossing[:n], share[:n]


def attribute_tokens(
    docs: DataFrame, ranks: bytes, pattern: str, rule: str = "most", sections: str | None = None
) -> DataFrame:
    """Token counts per section: doc_id, section, start, end, n_tokens, n_crossing, share, doc_tokens.

    `sections` names a column array<int> of rising character offsets b0 < b1 < ... (fields one after
    another: section i is [b_i, b_i+1)); without it the sections are the lines of the text, which
    fill it, so that n_tokens adds up to the document's tokens. start and end count characters.
    n_tokens allots a crossing token by `rule` (RULES); `share` splits it by characters.

    Every input row gives its sections, also a repeated one. A null or empty text is one empty
    section without tokens. Offsets beyond the text hold no tokens; a null or too short list of
    offsets gives one section, the whole text. Texts of any length are encoded whole. An empty
    table gives an empty one; other columns are not read.

    `ranks`: bytes of a rank file (under 2 MB, sent to each executor once), `pattern`: its splitting pattern.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kinds = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long, share double, doc_tokens long"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
         ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("share", pa.float64()), ("doc_tokens", pa.int64())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in schema]
            rows = np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                bounds = batch.column(2)[k].as_py() if sections else None
                if bounds is not None and len(bounds) > 1:
                    bounds = np.asarray(bounds, np.int64)
                else:
                    bounds = np.array([0, len(text)]) if sections else line_bounds(text)
                if text:
                    starts, ends = token_spans(text, encoder)
                    got = allot(starts, ends, bounds, rule)
                else:
                    starts, got = (), [np.zeros(len(bounds) - 1)] * 3
                n = rows[k] = len(bounds) - 1
                for column, values in zip(parts[1:], (np.arange(n), bounds[:-1], bounds[1:], *got, np.full(n, len(starts)))):
                    column.append(values)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), rows)))
            values = [np.concatenate(c) if c else np.zeros(0) for c in parts[1:]]
            yield arrow_rows(schema, [ids, *(v.astype(f.type.to_pandas_dtype()) for v, f in zip(values, list(schema)[1:]))])

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *([F.col(sections).cast("array<int>").alias("bounds")] if sections else []),
    )
    return slim.mapInArrow(count, kinds)
