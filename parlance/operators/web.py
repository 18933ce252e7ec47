"""Main content of web pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.html import read_page
from parlance.functions.text import clean_web

# Fixed limits: headings and links looked at, and shown.
HEADINGS_SEEN, HEADINGS_SHOWN = 30, 20
LINKS_SEEN, LINKS_SHOWN = 40, 20
MAX_CHARS = 12_000

_SCHEMA = (
    "page_id long, url string, title string, lang string, description string, text string, "
    "headings array<string>, links array<struct<text: string, href: string>>"
)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        read = [read_page(html or "", url or "") for html, url in zip(batch["html"], batch["url"])]
        out = pd.DataFrame(read, columns=["title", "lang", "description", "text", "headings", "links"])
        out["links"] = out["links"].map(lambda xs: [{"text": t, "href": h} for t, h in xs])
        yield pd.concat([batch[["page_id", "url"]].reset_index(drop=True), out], axis=1)


def _first_distinct(items: Column, seen: int, shown: int) -> Column:
    return F.slice(F.array_distinct(F.slice(items, 1, seen)), 1, shown)


def extract_content(pages: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Title, language, description, body text, headings and links of every page.

    The body is the longest article-like block if it holds a quarter of the page's text. Text over
    `max_chars` characters is cut with a notice; headings and links are distinct and capped.
    """
    parsed = pages.select("page_id", "url", "html").mapInPandas(_read, _SCHEMA)
    text = clean_web(F.col("text"))
    cut = F.concat(
        F.left(text, F.lit(max_chars)), F.lit(f"\n\n[内容过长，已截断到 {max_chars} 字]")
    )
    return parsed.select(
        "page_id",
        "url",
        "title",
        "lang",
        clean_web(F.col("description")).alias("description"),
        F.when(F.length(text) > max_chars, cut).otherwise(text).alias("text"),
        _first_distinct(F.col("headings"), HEADINGS_SEEN, HEADINGS_SHOWN).alias("headings"),
        _first_distinct(F.col("links"), LINKS_SEEN, LINKS_SHOWN).alias("links"),
    )


def page_digest(content: DataFrame) -> DataFrame:
    """(page_id, digest): the extracted content as one readable text."""

    def section(title: str, lines: Column) -> Column:
        return F.when(
            F.size(lines) > 0, F.concat(F.lit(f"{title}：\n"), F.array_join(lines, "\n"))
        )

    def labelled(label: str, col: Column) -> Column:
        return F.when(col != "", F.concat(F.lit(f"{label}："), col))

    headings = F.transform("headings", lambda h: F.concat(F.lit("- "), h))
    links = F.transform("links", lambda x: F.concat(F.lit("- "), x["text"], F.lit(": "), x["href"]))
    title = F.when(F.col("title") != "", F.col("title")).otherwise("(无标题)")
    body = F.when(F.col("text") != "", F.col("text")).otherwise("(未抽取到可见正文)")
    digest = F.concat_ws(
        "\n\n",
        F.concat(F.lit("标题："), title),
        F.concat(F.lit("URL："), F.coalesce("url", F.lit(""))),
        labelled("语言", F.col("lang")),
        labelled("页面描述", F.col("description")),
        section("主要标题", headings),
        F.concat(F.lit("正文：\n"), body),
        section("主要链接", links),
    )
    return content.select("page_id", digest.alias("digest"))
