"""Page text with quality control: score, choose the extraction, read within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parlance.operators.batches import batches_by_chars
from parlance.operators.pages import (
    MAX_CHARS,
    MAX_PAGES,
    best_pages,
    page_by_chars,
    with_quality,
)


def page_text(
    candidates: DataFrame, max_chars: int = MAX_CHARS, max_pages: int = MAX_PAGES,
    cursors: DataFrame | None = None,
) -> DataFrame:
    """Every batch of the best text of every document; with `cursors`, the one batch from there on."""
    chosen = best_pages(with_quality(candidates))
    if cursors is None:
        return batches_by_chars(chosen, max_chars, max_pages)
    return page_by_chars(chosen, max_chars, max_pages, cursors)
