"""Page specifications, page windows and page-text quality as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.numbers import round_half_even
from parlance.functions.text import alnum_length, strip, visible_length

# Fixed thresholds of the quality score.
MIN_CHARS = 20
MIN_CHARS_ON_IMAGE = 100
IMAGE_PAGE_COVERAGE = 0.5

CID = r"(?i)\(cid:\d+\)"
PAGE_NUMBER = r"(?imd)^[\s]*\d+\s*(?:of|/)\s*\d+\s*$"
STATUS_RANK = {"empty": 0, "poor": 1, "sparse": 2, "good": 3}

_INT = r"^\s*[+-]?\d+(_\d+)*\s*$"


def _int(text: Column) -> Column:
    digits = F.replace(strip(text), F.lit("_"), F.lit(""))
    return F.when(text.rlike(_INT), digits.try_cast("int"))


def parse_pages(col: Column, count: Column) -> Column:
    """`2,5-6` as struct(pages, error). Blank means every page.

    The error is the first of format, order, bounds met from left to right, or empty.
    """
    spec = strip(F.coalesce(col, F.lit("")))
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda x: x != "")

    def span(part: Column) -> Column:
        dash = F.instr(part, "-")
        low = _int(F.when(dash > 0, F.left(part, dash - 1)).otherwise(part))
        high = _int(F.when(dash > 0, F.substring(part, dash + 1, F.length(part))).otherwise(part))
        error = (
            F.when(low.isNull() | high.isNull(), "format")
            .when(low > high, "order")
            .when((low < 1) | (high > count), "bounds")
        )
        return F.struct(low.alias("low"), high.alias("high"), error.alias("error"))

    spans = F.transform(parts, span)
    errors = F.filter(F.transform(spans, lambda x: x["error"]), lambda x: x.isNotNull())
    error = F.when(spec == "", F.lit(None)).otherwise(
        F.coalesce(F.get(errors, F.lit(0)), F.when(F.size(parts) == 0, "empty"))
    )
    listed = F.array_sort(
        F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["low"], x["high"]))))
    )
    every = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    pages = F.when(spec == "", every).when(error.isNull(), listed)
    return F.struct(pages.alias("pages"), error.alias("error"))


def parse_weekdays(col: Column) -> Column:
    """JSON array or comma list of 1..7 as struct(days, error): format, type, bounds or empty."""
    text = strip(F.coalesce(col, F.lit("")))
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    is_json = text.startswith("[")

    def from_json(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        as_text = F.try_variant_get(item, "$", "string")
        as_number = F.try_variant_get(item, "$", "double")
        return F.when(kind == "STRING", _int(as_text)).when(
            kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), as_number.try_cast("int")
        )

    plain = F.transform(
        F.filter(F.transform(F.split(text, ","), strip), lambda x: x != ""), _int
    )
    days = F.when(is_json, F.transform(parsed, from_json)).otherwise(plain)
    error = (
        F.when(is_json & parsed.isNull(), "format")
        .when(F.exists(days, lambda x: x.isNull()), "type")
        .when(F.exists(days, lambda x: (x < 1) | (x > 7)), "bounds")
        .when(F.size(days) == 0, "empty")
    )
    return F.struct(
        F.when(error.isNull(), F.array_sort(F.array_distinct(days))).alias("days"),
        error.alias("error"),
    )


def page_window(count: Column, start: Column, end: Column, max_pages: Column) -> Column:
    """struct(start, end, next, error): the pages one call may read."""
    wanted = F.coalesce(end, count)
    error = (
        F.when(count < 1, "no_pages")
        .when((start < 1) | (start > count), "start")
        .when(max_pages < 1, "max_pages")
        .when((wanted < start) | (wanted > count), "end")
    )
    last = F.least(wanted, start + max_pages - 1)
    ok = error.isNull()
    return F.struct(
        F.when(ok, start).alias("start"),
        F.when(ok, last).alias("end"),
        F.when(ok & (last < wanted), last + 1).alias("next"),
        error.alias("error"),
    )


def page_quality(text: Column, coverage: Column) -> Column:
    """Quality of one extracted page: counts, status, score and the reasons in a fixed order."""
    text = F.coalesce(text, F.lit(""))
    coverage = F.coalesce(coverage.cast("double"), F.lit(0.0))
    visible = visible_length(text)
    meaningful = alnum_length(F.regexp_replace(text, PAGE_NUMBER, ""))
    cid = F.regexp_count(text, F.lit(CID))
    replaced = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))
    radical = F.regexp_count(text, F.lit(r"[\x{2E80}-\x{2FDF}]"))
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0e-\x1f]"))

    def many(count: Column, share: float) -> Column:
        return (count >= 3) | (count / visible >= share)

    bad = [
        (many(cid, 0.01), "包含大量 (cid:...) 字体映射占位符"),
        (many(replaced, 0.01), "包含大量 Unicode 替换字符"),
        ((radical >= 3) & (radical / visible >= 0.005), "包含疑似替代汉字的部首字符"),
        (many(control, 0.01), "包含异常控制字符"),
    ]
    any_bad = bad[0][0] | bad[1][0] | bad[2][0] | bad[3][0]
    on_image = (coverage >= IMAGE_PAGE_COVERAGE) & (meaningful < MIN_CHARS_ON_IMAGE)
    few = meaningful < MIN_CHARS
    status = (
        F.when(visible == 0, "empty")
        .when(any_bad, "poor")
        .when(on_image | few, "sparse")
        .otherwise("good")
    )
    percent = F.bround(coverage * 100).cast("int").cast("string")
    image_reason = F.concat(
        F.lit("页面图像覆盖约 "), percent, F.lit(f"%，且可提取文字少于 {MIN_CHARS_ON_IMAGE} 个字符")
    )
    reasons = (
        F.when(
            visible == 0,
            F.array(F.lit("未提取到可见文字"), F.when(coverage > 0, F.lit("页面包含图像对象"))),
        )
        .when(any_bad, F.array(*[F.when(test, F.lit(reason)) for test, reason in bad]))
        .when(on_image, F.array(image_reason))
        .when(few, F.array(F.lit(f"有效文字少于 {MIN_CHARS} 个字符")))
        .otherwise(F.array().cast("array<string>"))
    )
    penalty = F.least(F.lit(100), cid * 8 + replaced * 8 + radical * 2 + control * 4)
    score = (
        F.when(status == "empty", 0)
        .when(status == "sparse", F.least(F.lit(50), meaningful * 2))
        .otherwise(100 - penalty)
    )
    return F.struct(
        (coverage > 0).alias("has_image"),
        round_half_even(coverage, 4).alias("image_coverage"),
        status.alias("status"),
        score.cast("int").alias("score"),
        visible.alias("visible_chars"),
        meaningful.alias("meaningful_chars"),
        cid.alias("cid_tokens"),
        replaced.alias("replacement_chars"),
        radical.alias("radical_chars"),
        control.alias("control_chars"),
        F.array_compact(reasons).alias("reasons"),
    )


def status_rank(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair])
    return F.element_at(table, status)
