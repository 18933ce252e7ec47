"""Every batch of every document, as repeated budgeted reads would give them.

Where a batch ends depends on where it began, so batches follow one another. Tables and paragraphs are
numbered and cut into chunks of CHUNK rows, each with the few rows after it that a batch may reach. A
batch that begins at any row of a chunk has a known end, from running totals; following these ends, a
chunk is summed up as one table from the rows where the first batch may begin to where the next chunk's
first one does. Those tables, not the rows, are then followed from the start of the document, and each
chunk numbers its batches on its own. A document of any length is so spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.ordered import running_total
from parlance.operators.pages import MAX_CHARS, MAX_PAGES
from parlance.session import materialized

CHUNK = 65_536
#: Fixed value: less room than this is left unused rather than filled with the start of a page.
LEAST_PIECE = 500
DONE = -1

_BATCHES = pa.schema(
    [("doc_id", pa.int64()), ("batch", pa.int64()), ("first", pa.int64()), ("end", pa.int64()),
     ("start_page", pa.int64()), ("next", pa.int64()), ("next_page", pa.int64()), ("error", pa.string())]
)
_BATCH_KINDS = "doc_id long, batch long, first long, end long, start_page long, next long, next_page long, error string"
_STEPS = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int64()), ("leads_to", pa.int64()), ("passed", pa.int64())])
_ENTRIES = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int64()), ("batch", pa.int64())])


class Rule:
    """Where batches of up to `most` rows and `budget` of their sizes end.

    `first_fits`: a row beyond the budget is a batch by itself; else it ends the reading with an error.
    `cut`: the row that passes the budget is read in part, and again at the start of the next batch
    unless it was the only one. `window`: a batch reads so many pages at most, from its start page on.
    """

    def __init__(self, most: int, budget: int, first_fits: bool = True, cut: bool = False, window: int = 0):
        if most < 1 or budget < 1 or window < 0:
            raise ValueError("limits must be positive")
        self.most, self.budget, self.first_fits, self.cut, self.window = most, budget, first_fits, cut, window
        #: Start pages that a batch beginning at a row may have: the row's own, and those before it within the window.
        self.phases = max(window, 1)
        #: A batch reaches into the next chunk at most.
        self.chunk = max(CHUNK, most + 1)

    def ends(self, sizes: np.ndarray, pages: np.ndarray, count: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the first `count` rows and each phase: end of the batch, next row, next phase.

        A next row of len(sizes) is the end of the document if `last`; DONE ends it for an error.
        """
        n, row = len(sizes), np.arange(count)
        total = np.concatenate(([0], np.cumsum(sizes)))
        fit = np.searchsorted(total, total[:count] + self.budget, "right") - 1  # rows up to here fit
        if self.cut:
            # A table that fills the budget ends the batch; one that passes it is read in part.
            whole = np.searchsorted(total, total[:count] + self.budget, "left")  # rows up to here use up the budget
            end = np.minimum(np.minimum(whole, row + self.most), n)
            passed = total[end] - total[:count] > self.budget
            following = np.where(passed & (end - 1 > row), end - 1, end)
        else:
            end = np.minimum(np.minimum(fit, row + self.most), n)
            end = np.maximum(end, row + 1) if self.first_fits else end
            following = end
        ends, nexts, phases = (np.empty((count, self.phases), np.int64) for _ in range(3))
        for phase in range(self.phases):
            if not self.window:
                ends[:, phase], nexts[:, phase], phases[:, phase] = end, following, 0
                continue
            begin = pages[:count] - phase
            seen = np.searchsorted(pages, begin + self.window - 1, "right")
            stop = np.minimum(end, seen)
            after = begin + self.window  # the next start page, if the window was read whole
            at = np.minimum(stop, n - 1)
            ends[:, phase], nexts[:, phase] = stop, stop
            phases[:, phase] = np.where(seen <= end, (pages[at] - after) % self.window, 0)
        if not self.first_fits:
            bad = ends[:, 0] == row
            ends[bad], nexts[bad] = row[bad, None], DONE
        return ends, nexts, phases

    def start(self, page: int) -> int:
        """The phase of the first batch, which begins on page 1."""
        return (int(page) - 1) % self.window if self.window else 0


def _chunk(table: pa.Table, rule: Rule) -> tuple:
    """Rows of a chunk and those after it, in order, and their ends."""
    nth, size, page = (table.column(c).to_numpy() for c in ("nth", "size", "page"))
    order = np.argsort(nth)
    return _ends(nth[order], size[order], page[order], int(table.column("rows")[0].as_py()), rule)


def _ends(nth: np.ndarray, size: np.ndarray, page: np.ndarray, total: int, rule: Rule) -> tuple:
    count = min(rule.chunk, len(nth))
    last = nth[0] + len(nth) == total
    ends, nexts, phases = rule.ends(size, page, count, last)
    return nth, size, page, count, total, ends, nexts, phases


def _transfer(rule: Rule):
    """For each row and phase where a chunk's first batch may begin: where the next chunk's first one does, and batches passed."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        nth, _, page, count, total, _, nexts, phases = _chunk(table, rule)
        chunk = key[1].as_py()
        nodes = (np.where(nexts == DONE, DONE, nexts * rule.phases + phases)).ravel()
        nodes[(nexts + nth[0] >= total).ravel()] = DONE
        width, leads, passed = rule.phases, nodes.tolist(), [1] * (count * rule.phases)
        border = count * width
        for k in range(border - 1, -1, -1):  # the ends of later rows are known
            node = leads[k]
            if 0 <= node < border:
                leads[k], passed[k] = leads[node], passed[node] + 1
        entries = [rule.start(page[0])] if chunk == 0 else list(range(min(rule.most * width, border)))
        there = [leads[e] if leads[e] == DONE else leads[e] - border for e in entries]
        n = len(entries)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array(entries, pa.int64()),
                         pa.array(there, pa.int64()), pa.array([passed[e] for e in entries], pa.int64())], schema=_STEPS)

    return run


def _follow(key: tuple, table: pa.Table) -> pa.Table:
    """Where the first batch of each chunk of a document begins, and its number."""
    chunk, entry, leads, passed = (table.column(c).to_numpy() for c in ("chunk", "entry", "leads_to", "passed"))
    order = np.lexsort((entry, chunk))
    chunk, entry, leads, passed = chunk[order], entry[order], leads[order], passed[order]
    heads = np.searchsorted(chunk, np.arange(chunk[-1] + 2))
    node, batch, out = int(entry[0]), 0, []
    for c in range(len(heads) - 1):
        if node == DONE:
            break
        out.append((c, node, batch))
        at = heads[c] + (0 if c == 0 else node)
        node, batch = int(leads[at]), batch + int(passed[at])
    values = np.array(out, np.int64).reshape(-1, 3)
    return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), *(pa.array(values[:, k]) for k in range(3))], schema=_ENTRIES)


_WALKED = ("doc_id", "chunk", "nth", "size", "page", "rows", "entry", "batch")


def _walk(rule: Rule):
    """The batches that begin in each chunk, from its first one on; chunks come one after another, their rows in order.

    Most documents are a few rows long, so chunks share Arrow batches; only the rows of the open one are carried on.
    """

    def follow(doc: int, chunk: int, rows: tuple, entry: float, number: float, out: list[tuple]) -> None:
        nth, _, page, count, total, ends, nexts, phases = _ends(*rows, rule)
        if chunk == 0:
            entry, number = rule.start(page[0]), 0
        if np.isnan(entry):
            return
        number = int(number)
        row, phase = divmod(int(entry), rule.phases)
        while 0 <= row < count:
            end, following = int(ends[row, phase]), int(nexts[row, phase])
            begin = int(page[row]) - phase
            wrong = following == DONE
            whole = wrong or nth[0] + following >= total
            after = None if whole else int(phases[row, phase])
            first = int(nth[0]) + row
            out.append((doc, number, first, int(nth[0]) + end, begin, first if wrong else None if whole else int(nth[0]) + following,
                        begin if wrong else None if whole else int(page[following]) - after, "first_table_too_large" if wrong else None))
            row, phase, number = (DONE, 0, number + 1) if whole else (following, after, number + 1)

    def walked(held: list[pa.RecordBatch], more: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        table = pa.Table.from_batches(held).combine_chunks()
        doc, chunk, nth, size, page, total, entry, number = (table.column(c).to_numpy() for c in _WALKED)
        bounds = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(chunk) != 0)) + 1).tolist(), len(doc)]
        out: list[tuple] = []
        for a, b in zip(bounds, bounds[1:-1] if more else bounds[1:]):
            follow(int(doc[a]), int(chunk[a]), (nth[a:b], size[a:b], page[a:b], int(total[a])), float(entry[a]), float(number[a]), out)
        columns = list(zip(*out)) or [()] * len(_BATCHES)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BATCHES)], schema=_BATCHES)
        return made, table.slice(bounds[-2]).to_batches() if more else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [(b.column(k)[at].as_py()) for b, at in ((held[0] if held else batch, 0), (batch, -1)) for k in (0, 1)]
            held.append(batch)
            if ends[:2] != ends[2:]:  # the open chunk ends in this batch
                made, held = walked(held, True)
                if made.num_rows:
                    yield made
        if held:
            yield walked(held, False)[0]

    return scan


def _batches(rows: DataFrame, rule: Rule) -> DataFrame:
    """The batches of numbered rows (doc_id, nth, size, page): first row, end, start page and where the next one begins."""
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    chunk = F.expr(f"nth div {rule.chunk}")
    # The rows after a chunk that its last batches may reach are in both chunks.
    near = F.when((chunk > 0) & (F.col("nth") % rule.chunk <= rule.most), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    spread = rows.join(counted, "doc_id").withColumn("chunk", F.explode(near))
    long = spread.filter(F.col("rows") > rule.chunk)
    steps = long.groupBy("doc_id", "chunk").applyInArrow(_transfer(rule), "doc_id long, chunk long, entry long, leads_to long, passed long")
    entries = steps.groupBy("doc_id").applyInArrow(_follow, "doc_id long, chunk long, entry long, batch long")
    known = spread.join(entries, ["doc_id", "chunk"], "left").select(*_WALKED)
    ordered = known.repartition("doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", "nth")
    return materialized(ordered.mapInArrow(_walk(rule), _BATCH_KINDS))


def _with_batch(rows: DataFrame, batches: DataFrame, most: int) -> DataFrame:
    """Rows with each batch that holds them. A batch has `most` rows at most, so it lies in two buckets of that size."""
    bucket = F.expr(f"sequence(first div {most}, greatest(end - 1, first) div {most})")
    spread = batches.filter("end > first").select("doc_id", "batch", "first", "end", F.explode(bucket).alias("_bucket"))
    held = (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("end"))
    joined = rows.withColumn("_bucket", F.expr(f"nth div {most}")).join(spread, ["doc_id", "_bucket"])
    return joined.filter(held).drop("_bucket", "end")


def _numbered(rows: DataFrame, order: list[str], bucket: str, size, page) -> tuple[DataFrame, DataFrame]:
    """(all columns and `nth`, counted from 0; what the walk needs)."""
    numbered = running_total(rows, ["doc_id"], order, F.expr(bucket), out="nth").withColumn("nth", F.col("nth") - 1)
    slim = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), "nth", size.cast("long").alias("size"), page.cast("long").alias("page"))
    return numbered, slim


def batches_by_paragraphs(paragraphs: DataFrame, max_paragraphs: int = 80, max_chars: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """(paragraphs with their `batch`, one row per batch with its paragraphs, characters and next_paragraph).

    `paragraphs` holds doc_id (an integer), pos and text; reading begins at the lowest pos. A batch
    takes paragraphs while both limits hold, the first one always. Every paragraph is in one batch;
    a null text has no characters. next_paragraph is null for the last batch.
    """
    length = F.coalesce(F.length("text"), F.lit(0))
    numbered, slim = _numbered(paragraphs, ["pos"], "pos DIV 4096", length, F.lit(1))
    batches = _batches(slim, Rule(max_paragraphs, max_chars))
    rows = _with_batch(numbered, batches, max_paragraphs)
    cursor = rows.groupBy("doc_id", "batch").agg(
        F.count("*").alias("paragraph_count"), F.sum(length).alias("char_count"), F.min("pos").alias("first_paragraph")
    )
    later = cursor.select("doc_id", (F.col("batch") - 1).alias("batch"), F.col("first_paragraph").alias("next_paragraph"))
    return rows.select(*paragraphs.columns, "batch"), cursor.drop("first_paragraph").join(later, ["doc_id", "batch"], "left")


def batches_by_tables(
    tables: DataFrame, max_tables: int = 20, max_cells: int = 2000, max_pages: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(tables with their `batch`, one row per batch with its start_page, tables, cells, next_page, next_table and error).

    `tables` holds doc_id (an integer), page, table_idx and cells. A batch reads `max_pages` pages from
    its start page on and stops before the table that would exceed a limit; the next one starts there,
    or on the page after the window. Windows without a table are passed over and have no batch. A first
    table beyond `max_cells` ends the document's reading: its batch has no tables and an error.
    """
    numbered, slim = _numbered(tables, ["page", "table_idx"], "page", F.col("cells"), F.col("page"))
    batches = _batches(slim, Rule(max_tables, max_cells, first_fits=False, window=max_pages))
    rows = _with_batch(numbered, batches, max_tables)
    held = rows.groupBy("doc_id", "batch").agg(F.count("*").alias("table_count"), F.sum("cells").alias("cell_count"))
    place = numbered.select(F.col("doc_id"), F.col("nth").alias("next"), F.col("page").alias("_page"), F.col("table_idx").alias("_table"))
    cursor = batches.join(held, ["doc_id", "batch"], "left").join(place, ["doc_id", "next"], "left")
    # The next batch starts at a table if this one stopped before it, else at the start of a window.
    at_table = F.col("error").isNotNull() | (F.col("_page") < F.col("start_page") + max_pages)
    cursor = cursor.select(
        "doc_id", "batch", "start_page",
        F.coalesce("table_count", F.lit(0)).alias("table_count"),
        F.coalesce("cell_count", F.lit(0)).alias("cell_count"),
        F.when(at_table, F.col("_page")).otherwise(F.col("next_page")).cast("int").alias("next_page"),
        F.when(at_table, F.col("_table")).when(F.col("next").isNotNull(), 0).alias("next_table"),
        "error",
    )
    return rows.select(*tables.columns, "batch"), cursor


def batches_by_cells(tables: DataFrame, max_tables: int = 10, max_cells: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(tables with their `batch`, the cells `used` of each and whether it was `truncated`; tables and next_table per batch).

    `tables` holds doc_id (an integer), table_idx and cells. The table that exhausts the budget is cut
    and read again at the start of the next batch, unless it was alone: then reading goes on after it.
    """
    numbered, slim = _numbered(tables, ["table_idx"], "table_idx DIV 4096", F.col("cells"), F.lit(1))
    batches = _batches(slim, Rule(max_tables, max_cells, cut=True))
    rows = _with_batch(numbered, batches, max_tables)
    before = Window.partitionBy("doc_id", "batch").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(max_cells) - F.coalesce(F.sum("cells").over(before), F.lit(0))
    rows = rows.withColumn("used", F.least("cells", left)).withColumn("truncated", F.col("cells") > F.col("used"))
    place = numbered.select("doc_id", F.col("nth").alias("next"), F.col("table_idx").alias("next_table"))
    cursor = batches.select("doc_id", "batch", (F.col("end") - F.col("first")).alias("table_count"), "next").join(place, ["doc_id", "next"], "left")
    return rows.select(*tables.columns, "batch", "used", "truncated"), cursor.drop("next")


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("page", pa.int32()), ("batch", pa.int64()), ("offset_start", pa.int32()), ("offset_end", pa.int32()),
     ("complete", pa.bool_()), ("next_page", pa.int32()), ("next_offset", pa.int32())]
)


def _pieces(max_chars: int, max_pages: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        page, length, usable = (table.column(c).to_numpy() for c in ("page", "length", "usable"))
        order = np.argsort(page)
        pages, lengths = page[order].tolist(), np.where(usable, length, 0)[order].tolist()
        out: list[list] = []
        at = offset = batch = 0
        while at < len(pages):
            begin, room, rows = at, max_chars, []
            until = pages[begin] + max_pages
            while at < len(pages) and pages[at] < until:
                rest = lengths[at] - offset
                if not usable[order[at]]:
                    rows.append([pages[at], 0, 0, True])
                elif room and rest <= room:
                    rows.append([pages[at], offset, offset + rest, True])
                    room -= rest
                else:
                    # A page that does not fit is cut, unless little room is left and something was read.
                    if room and (room == max_chars or room >= min(LEAST_PIECE, rest)):
                        rows.append([pages[at], offset, offset + room, False])
                        offset += room
                    break
                at, offset = at + 1, 0
            there = [pages[at], offset] if at < len(pages) else [None, 0]
            out += [[p, batch, *piece, *there] for p, *piece in rows]
            batch += 1
        columns = list(zip(*out)) or [()] * 7
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_PIECES)[1:]))], schema=_PIECES)

    return run


def batches_by_chars(pages: DataFrame, max_chars: int = MAX_CHARS, max_pages: int = MAX_PAGES) -> DataFrame:
    """Every batch of page text of every document within a character budget, numbered from 0.

    `pages` holds doc_id (an integer), page (from 1, unique in its document), engine, status and text.
    A batch reads whole pages, `max_pages` at most, while the budget lasts; a page that overflows it is
    cut and goes on in the next batch, unless the rest of the budget is under min(500, its rest) and
    something was read. Pages that are not good are read empty, at no cost. All pieces of a good page
    joined are its text. next_page and next_offset are where the next batch starts, null and 0 after the last.

    A cut depends on all before it, so one task follows the pages of a document, of which it sees
    only the lengths (some 16 bytes a page); the texts are cut where they are.
    """
    if max_chars < 1 or max_pages < 1:
        raise ValueError("limits must be positive")
    usable = F.coalesce(F.col("status") == "good", F.lit(False))
    length = F.coalesce(F.length("text"), F.lit(0))
    slim = pages.select(F.col("doc_id").cast("long").alias("doc_id"), "page", length.alias("length"), usable.alias("usable"))
    kinds = "doc_id long, page int, batch long, offset_start int, offset_end int, complete boolean, next_page int, next_offset int"
    pieces = slim.groupBy("doc_id").applyInArrow(_pieces(max_chars, max_pages), kinds)
    return pages.join(pieces, ["doc_id", "page"]).select(
        "doc_id", "batch", "page",
        F.when(usable, F.substring("text", F.col("offset_start") + 1, F.col("offset_end") - F.col("offset_start"))).otherwise("").alias("text"),
        length.alias("char_count"), "offset_start", "offset_end", "complete",
        usable.alias("usable_for_summary"),
        F.col("status").alias("text_quality_status"),
        F.col("engine").alias("extractor"),
        "next_page", "next_offset",
    )
