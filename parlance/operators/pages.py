"""Page text quality, choice of extraction, budgeted reading and page table edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.numbers import round_half_even
from parlance.functions.pages import page_quality, page_window, parse_pages, status_rank
from parlance.functions.text import SPACE
from parlance.operators.ordered import dedupe_first, first_rows, running_total

MAX_PAGES = 8
MAX_CHARS = 24_000
COUNTERS = (
    "visible_chars", "meaningful_chars", "cid_tokens", "replacement_chars", "radical_chars",
    "control_chars",
)


def with_quality(pages: DataFrame) -> DataFrame:
    """Add the quality columns of every page, computed in the scan stage."""
    scored = pages.withColumn("_q", page_quality(F.col("text"), F.col("image_coverage")))
    kept = [c for c in pages.columns if c != "image_coverage"]
    return scored.select(*kept, "_q.*")


def doc_quality(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Roll page quality up to one row per document: status, score, counters and page counts.

    Page lists and reasons stay in rows (`page_lists`, `doc_reasons`), so that a document of any
    length never becomes one huge cell.
    """
    good = F.col("status") == "good"
    hollow = F.col("status").isin("empty", "sparse")
    rolled = pages.groupBy(*(keys or ["doc_id"])).agg(
        F.count("*").alias("pages"),
        F.bool_and(good).alias("_all_good"),
        F.bool_or(good).alias("_some_good"),
        F.bool_and(hollow).alias("_all_hollow"),
        F.bround(F.sum("score") / F.count("*")).cast("int").alias("score"),
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.count_if("has_image").alias("image_pages"),
        F.count_if(good).alias("good_pages"),
        F.count_if(~good).alias("suspect_pages"),
    )
    status = (
        F.when(F.col("_all_good"), "good")
        .when(F.col("_some_good"), "mixed")
        .when(F.col("_all_hollow"), "empty")
        .otherwise("poor")
    )
    return rolled.withColumn("status", status).drop("_all_good", "_some_good", "_all_hollow")


def page_lists(pages: DataFrame) -> DataFrame:
    """(doc_id, list, page) rows of the lists image, good and suspect."""
    names = F.array_compact(
        F.array(
            F.when(F.col("has_image"), F.lit("image")),
            F.when(F.col("status") == "good", F.lit("good")).otherwise(F.lit("suspect")),
        )
    )
    return pages.select("doc_id", "page", F.explode(names).alias("list"))


def doc_reasons(pages: DataFrame) -> DataFrame:
    """One row per page and reason, numbered within the page."""
    rows = pages.select("doc_id", "page", F.posexplode("reasons").alias("nth", "reason"))
    message = F.concat(F.lit("第 "), F.col("page"), F.lit(" 页："), F.col("reason"))
    return rows.select("doc_id", "page", "nth", message.alias("message"))


def best_pages(candidates: DataFrame) -> DataFrame:
    """One extraction per page from scored candidates (doc_id, page, engine, engine_order, ...).

    The first engine whose whole document is good supplies every page. Without one, each page
    takes the best status, then score, then visible characters; ties go to the earlier engine.
    """
    per_engine = candidates.groupBy("doc_id", "engine_order").agg(
        F.bool_and(F.col("status") == "good").alias("_good")
    )
    whole = per_engine.groupBy("doc_id").agg(
        F.min(F.when(F.col("_good"), F.col("engine_order"))).alias("_whole")
    )
    preferred = F.coalesce(F.col("engine_order") == F.col("_whole"), F.lit(False))
    order = [
        preferred.desc(),
        status_rank(F.col("status")).desc(),
        F.col("score").desc(),
        F.col("visible_chars").desc(),
        F.col("engine_order"),
    ]
    return dedupe_first(candidates.join(whole, "doc_id"), ["doc_id", "page"], order).drop("_whole")


def engine_label(chosen: DataFrame) -> DataFrame:
    """The engine a document's pages came from, `hybrid` for more than one."""
    used = chosen.groupBy("doc_id").agg(
        F.min("engine").alias("_one"), F.max("engine").alias("_other")
    )
    label = F.when(F.col("_one") == F.col("_other"), F.col("_one")).otherwise("hybrid")
    return used.select("doc_id", label.alias("engine"))


def _with_cursor(
    rows: DataFrame, counts: DataFrame, cursors: DataFrame | None, fields: dict[str, int]
) -> DataFrame:
    """Attach per-document start positions (defaults without a cursor table) and page counts."""
    if cursors is None:
        for name, default in fields.items():
            rows = rows.withColumn(name, F.lit(default))
    else:
        rows = rows.join(cursors, "doc_id", "left")
        for name, default in fields.items():
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return rows.join(counts, "doc_id")


def page_by_chars(
    pages: DataFrame, max_chars: int = MAX_CHARS, max_pages: int = MAX_PAGES,
    cursors: DataFrame | None = None,
) -> DataFrame:
    """The next batch of page text of every document within a character budget.

    Whole pages while the budget lasts; the page that overflows is cut, unless the rest of the
    budget is under min(500, its rest) and something was emitted. Pages that are not good come out
    empty and cost nothing. `cursors` may give start_page and start_offset per document; the
    returned next_page and next_offset continue from there. A batch is at most `max_pages` pages,
    so no window here sees more rows than that.
    """
    counts = pages.groupBy("doc_id").agg(F.max("page").alias("page_count"))
    if cursors is None:
        pages = pages.filter(F.col("page") <= max_pages)
    rows = _with_cursor(pages, counts, cursors, {"start_page": 1, "start_offset": 0})
    window = page_window(
        F.col("page_count"), F.col("start_page"), F.lit(None).cast("int"), F.lit(max_pages)
    )
    rows = rows.withColumn("_w", window).filter(F.col("page").between(F.col("_w.start"), F.col("_w.end")))
    first = F.col("page") == F.col("start_page")
    usable = F.col("status") == "good"
    offset = F.when(first, F.col("start_offset")).otherwise(0)
    rows = rows.select(
        "doc_id",
        "page",
        "engine",
        "status",
        usable.alias("usable"),
        offset.alias("offset"),
        F.length("text").alias("char_count"),
        F.when(usable, F.greatest(F.length("text") - offset, F.lit(0))).otherwise(0).alias("rest"),
        # No page can contribute more than the budget, so no more text travels.
        F.when(usable, F.substring("text", offset + 1, F.lit(max_chars))).alias("piece"),
        F.when(offset > F.length("text"), "offset_past_end")
        .when(~usable & (offset > 0), "offset_on_unusable_page")
        .alias("error"),
        F.col("_w.next").alias("window_next"),
    )
    in_order = Window.partitionBy("doc_id").orderBy("page")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum("rest").over(before), F.lit(0)))
    budget = F.lit(max_chars) - F.col("used")
    over = F.col("usable") & ((budget <= 0) | (F.col("rest") > budget))
    skip = (budget <= 0) | (
        (F.col("used") > 0) & (budget < F.least(F.lit(500), F.col("rest")))
    )
    rows = rows.withColumn("_over", over).withColumn("_skip", over & skip)
    rows = rows.withColumn("_taken", F.when(over, F.least("rest", budget)).otherwise(F.col("rest")))
    whole = Window.partitionBy("doc_id")
    rows = (
        rows.withColumn("_stop", F.min(F.when(over, F.col("page"))).over(whole))
        .withColumn("error", F.max("error").over(whole))
        .filter(F.col("_stop").isNull() | (F.col("page") <= F.col("_stop")))
    )
    stop_offset = F.when(
        F.col("_over"),
        F.when(F.col("_skip"), F.col("offset")).otherwise(F.col("offset") + F.col("_taken")),
    )
    rows = rows.withColumn(
        "next_page", F.coalesce(F.col("_stop"), F.col("window_next"))
    ).withColumn("next_offset", F.coalesce(F.max(stop_offset).over(whole), F.lit(0)))
    return rows.filter(F.col("error").isNotNull() | ~F.col("_skip")).select(
        "doc_id",
        "page",
        F.when(F.col("usable"), F.substring("piece", F.lit(1), F.col("_taken")))
        .otherwise("")
        .alias("text"),
        "char_count",
        F.when(F.col("usable"), F.col("offset")).otherwise(0).alias("offset_start"),
        F.when(F.col("usable"), F.col("offset") + F.col("_taken")).otherwise(0).alias("offset_end"),
        (~F.col("_over")).alias("complete"),
        F.col("usable").alias("usable_for_summary"),
        F.col("status").alias("text_quality_status"),
        F.col("engine").alias("extractor"),
        "next_page",
        F.col("next_offset").cast("int").alias("next_offset"),
        "error",
    )


def page_by_tables(
    tables: DataFrame, counts: DataFrame, max_tables: int = 20, max_cells: int = 2000,
    max_pages: int = 5, cursors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(tables of the next batch, one cursor row per document).

    `tables` holds doc_id, page, table_idx, cells; `counts` doc_id, page_count. The batch stops
    before the table that would exceed either limit; a first table over the cell limit is an error.
    """
    rows = _with_cursor(tables, counts, cursors, {"start_page": 1, "start_table": 0})
    window = page_window(
        F.col("page_count"), F.col("start_page"), F.lit(None).cast("int"), F.lit(max_pages)
    )
    rows = rows.withColumn("_w", window).filter(
        F.col("page").between(F.col("_w.start"), F.col("_w.end"))
        & ((F.col("page") > F.col("start_page")) | (F.col("table_idx") >= F.col("start_table")))
    )
    # One table beyond the limit is enough to see the breach.
    rows = first_rows(rows, ["doc_id"], ["page", "table_idx"], max_tables + 1, rank="nth")
    running = (
        Window.partitionBy("doc_id")
        .orderBy("nth")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_sum", F.sum("cells").over(running))
    kept = (F.col("nth") <= max_tables) & (F.col("_sum") <= max_cells)
    rows = rows.withColumn("_kept", kept)
    stopped = F.min(F.when(~F.col("_kept"), F.struct("page", "table_idx")))
    cursor = rows.groupBy("doc_id").agg(
        F.count_if("_kept").alias("table_count"),
        F.coalesce(F.sum(F.when(F.col("_kept"), F.col("cells"))), F.lit(0)).alias("cell_count"),
        stopped.alias("_stop"),
        F.max(F.col("_w.next")).alias("_window_next"),
        F.bool_or((F.col("nth") == 1) & (F.col("cells") > max_cells)).alias("_error"),
    )
    cursor = cursor.select(
        "doc_id",
        "table_count",
        "cell_count",
        F.col("_stop").isNotNull().alias("truncated"),
        F.coalesce(F.col("_stop.page"), F.col("_window_next")).alias("next_page"),
        F.coalesce(F.col("_stop.table_idx"), F.lit(0)).alias("next_table"),
        F.when(F.col("_error"), "first_table_too_large").alias("error"),
    )
    return rows.filter("_kept").select(*tables.columns), cursor


def page_by_paragraphs(
    paragraphs: DataFrame, max_paragraphs: int = 80, max_chars: int = 40_000, start: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(paragraphs of the next batch, next_paragraph per document). The first always fits."""
    rows = paragraphs.filter(F.col("pos") >= start).withColumn("_len", F.length("text"))
    rows = first_rows(rows, ["doc_id"], ["pos"], max_paragraphs + 1, rank="_nth")
    running = (
        Window.partitionBy("doc_id")
        .orderBy("_nth")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_sum", F.sum("_len").over(running))
    kept = (F.col("_nth") <= max_paragraphs) & (
        (F.col("_nth") == 1) | (F.col("_sum") <= max_chars)
    )
    rows = rows.withColumn("_kept", kept)
    cursor = rows.groupBy("doc_id").agg(
        F.count_if("_kept").alias("paragraph_count"),
        F.coalesce(F.sum(F.when(F.col("_kept"), F.col("_len"))), F.lit(0)).alias("char_count"),
        F.min(F.when(~F.col("_kept"), F.col("pos"))).alias("next_paragraph"),
    )
    return rows.filter("_kept").select(*paragraphs.columns), cursor


def tables_by_cells(
    tables: DataFrame, max_tables: int = 10, max_cells: int = 1000, start: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(tables read with the cells `used` of each, next_table per document).

    `tables` holds doc_id, table_idx, cells. The table that exhausts the budget is cut.
    """
    rows = tables.filter(F.col("table_idx") >= start)
    rows = first_rows(rows, ["doc_id"], ["table_idx"], max_tables + 1, rank="_nth")
    before = (
        Window.partitionBy("doc_id").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn(
        "_left", F.lit(max_cells) - F.coalesce(F.sum("cells").over(before), F.lit(0))
    )
    kept = (F.col("_nth") <= max_tables) & (F.col("_left") > 0)
    cut = kept & (F.col("cells") > F.col("_left"))
    rows = rows.withColumn("_kept", kept).withColumn("truncated", cut)
    rows = rows.withColumn("used", F.least("cells", "_left"))
    cursor = rows.groupBy("doc_id").agg(
        F.count_if("_kept").alias("table_count"),
        F.min(F.when(~F.col("_kept") | F.col("truncated"), F.col("table_idx"))).alias("next_table"),
    )
    return rows.filter("_kept").select(*tables.columns, "used", "truncated"), cursor


def layout_histogram(pages: DataFrame) -> DataFrame:
    """Pages by (width, height, rotation), sorted; sizes to 2 decimals, rotation modulo 360."""
    return (
        pages.groupBy(
            round_half_even(F.col("width"), 2).alias("width_points"),
            round_half_even(F.col("height"), 2).alias("height_points"),
            F.pmod(F.coalesce(F.col("rotation"), F.lit(0)), F.lit(360)).alias("rotation"),
        )
        .agg(F.count("*").alias("count"))
        .orderBy("width_points", "height_points", "rotation")
    )


def text_totals(paragraphs: DataFrame) -> DataFrame:
    """Characters of the joined paragraphs and white-space separated words per document."""
    words = F.size(F.filter(F.split("text", f"[{SPACE}]+"), lambda x: x != ""))
    return paragraphs.groupBy("doc_id").agg(
        (F.sum(F.length("text")) + F.count("*") - 1).alias("character_count"),
        F.sum(words).alias("word_count"),
    )


def _page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))


def reorder(pages: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their new position, orders that are no permutation of 1..n).

    `orders` holds doc_id and `order`, the old positions in their new order.
    """
    checked = orders.join(_page_counts(pages), "doc_id", "left")
    full = F.array_sort(F.col("order")) == F.sequence(
        F.lit(1), F.greatest(F.col("page_count"), F.lit(1))
    )
    checked = checked.withColumn("_ok", F.coalesce(full, F.lit(False)))
    moves = checked.filter("_ok").select("doc_id", F.posexplode("order").alias("_to", "page"))
    moved = pages.join(moves, ["doc_id", "page"]).withColumn("position", F.col("_to") + 1)
    return moved.drop("_to"), checked.filter("NOT _ok").select("doc_id", "order")


def drop_positions(pages: DataFrame, drops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining pages, renumbered as `position`; rejected drops).

    `drops` holds doc_id and `positions`. Positions out of range, an empty list, or dropping every
    page reject the whole drop; the document then keeps all pages.
    """
    checked = drops.join(_page_counts(pages), "doc_id", "left")
    gone = F.array_distinct("positions")
    error = (
        F.when(F.size(gone) < 1, "empty")
        .when(F.exists(gone, lambda x: (x < 1) | (x > F.col("page_count"))), "bounds")
        .when(F.size(gone) >= F.col("page_count"), "all")
    )
    checked = checked.withColumn("error", error).withColumn("_gone", gone)
    valid = checked.filter("error IS NULL").select("doc_id", "_gone")
    rows = pages.join(valid, "doc_id", "left").withColumn(
        "_gone", F.coalesce("_gone", F.array().cast("array<int>"))
    )
    earlier = F.size(F.filter("_gone", lambda x: x < F.col("page")))
    kept = rows.filter(~F.array_contains("_gone", F.col("page")))
    return (
        kept.withColumn("position", F.col("page") - earlier).drop("_gone"),
        checked.filter("error IS NOT NULL").select("doc_id", "positions", "error"),
    )


def concat_pages(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Merge documents: `plan` holds output, ordinal and doc_id; pages are renumbered as `position`.

    The start of each input is a running total over page counts, so pages themselves need no sort.
    """
    inputs = plan.join(_page_counts(pages), "doc_id")
    ends = running_total(
        inputs, ["output"], ["ordinal"], F.expr("ordinal DIV 4096"), F.col("page_count"), out="_end"
    )
    starts = ends.select("output", "ordinal", "doc_id", (F.col("_end") - F.col("page_count")).alias("_start"))
    return pages.join(starts, "doc_id").withColumn(
        "position", F.col("_start") + F.col("page")
    ).drop("_start")


def split_pages(pages: DataFrame, ranges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with the `label` and output `name` they belong to, rejected ranges).

    `ranges` holds doc_id and label (a page specification); without it every page is its own part.
    """
    if ranges is None:
        label = F.col("page").cast("string")
        alone = pages.withColumn("label", label).withColumn("name", F.concat(F.lit("pages_"), label))
        return alone, alone.limit(0).select("doc_id", "label", F.lit("").alias("error"))
    specs = ranges.join(_page_counts(pages), "doc_id").withColumn(
        "_spec", parse_pages(F.col("label"), F.col("page_count"))
    )
    safe = F.regexp_replace(F.replace("label", F.lit(","), F.lit("_")), "[^0-9_-]+", "_")
    picked = specs.filter("_spec.error IS NULL").select(
        "doc_id", "label", F.concat(F.lit("pages_"), safe).alias("name"),
        F.explode("_spec.pages").alias("page"),
    )
    rejected = specs.filter("_spec.error IS NOT NULL").select(
        "doc_id", "label", F.col("_spec.error").alias("error")
    )
    return pages.join(picked, ["doc_id", "page"]), rejected
