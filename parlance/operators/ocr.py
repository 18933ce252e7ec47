"""OCR lines of pages: ordering, scoring, and reconciliation with the native text layer.

Lines hold doc_id, page, idx, text, confidence and box (four corner points); native lines hold
doc_id, page, key (see `match_key`) and a box x0, y0, x1, y1 scaled to the page.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.boxes import box_area, centre, norm_box, point_in_box, round_points
from parlance.functions.numbers import round_half_even
from parlance.functions.text import alnum_length, clean_lines, has_text, match_key, text_key, visible_length
from parlance.operators.matching import containing, grid_cell, in_any_box, with_cells
from parlance.operators.ordered import dedupe_first, running_total
from parlance.session import materialized

PAGE = ["doc_id", "page"]

# Fixed thresholds.
MIN_CONFIDENCE = 0.60
MIN_CHARS = 5
MIN_IMAGE_AREA = 0.015
SIMILAR = 0.82
SIMILAR_IN_BOX = 0.68
IMAGE_PAD = 0.005
NATIVE_PAD = 0.01
NEAR_CONTAINED = 1.25
WORD_BAND = 2.5
LINE_GAP = 3.0

#: Letter pairs whose counts reach the driver.
FREQUENT_PAIRS = 4096
#: Rows and characters of lines of one page that a task looks at together.
PAGE_ROWS, PAGE_CHARS = 2_000, 4_000_000


def prepared_lines(lines: DataFrame) -> DataFrame:
    """Clean text, clamp confidence, round boxes and add the sort keys; empty lines drop out."""
    confidence = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    box = round_points(F.col("box"))
    index = F.col("idx").cast("double")

    def lowest(axis: int) -> Column:
        return F.coalesce(
            F.array_min(F.transform("box", lambda p: F.get(p, F.lit(axis)))), index
        )

    rows = (
        lines.filter(has_text(F.col("text")))
        .withColumn("text", clean_lines(F.col("text")))
        .withColumn("confidence", F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))
        .withColumn("box", box)
    )
    return rows.withColumn("left", lowest(0)).withColumn(
        "band", F.bround(lowest(1) / 10).cast("long")
    )


def reading_order(lines: DataFrame) -> DataFrame:
    """Add `position` per page: bands of ten units from the top, then left, then index."""
    return running_total(
        prepared_lines(lines), PAGE, ["band", "left", "idx"], F.col("band"), out="position"
    )


def ocr_page_summary(
    lines: DataFrame, pages: DataFrame | None = None, empty: str = "empty"
) -> DataFrame:
    """Length-weighted confidence, counts and status per page.

    With `pages`, pages without any line appear too, under the status `empty`.
    """
    weight = F.greatest(F.lit(1), visible_length(F.col("text")))
    summary = lines.groupBy(*PAGE).agg(
        F.count("*").alias("line_count"),
        F.count_if(F.col("confidence") < MIN_CONFIDENCE).alias("low_confidence_line_count"),
        (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("_mean"),
        F.sum(alnum_length(F.col("text"))).alias("meaningful_chars"),
    )
    if pages is not None:
        summary = pages.select(*PAGE).distinct().join(summary, PAGE, "left")
    mean = F.coalesce("_mean", F.lit(0.0))
    count = F.coalesce("line_count", F.lit(0))
    chars = F.coalesce("meaningful_chars", F.lit(0))
    status = (
        F.when(count == 0, empty)
        .when(chars < MIN_CHARS, "sparse")
        .when(mean < MIN_CONFIDENCE, "low_confidence")
        .otherwise("good")
    )
    return summary.select(
        *PAGE,
        status.alias("status"),
        count.alias("line_count"),
        F.coalesce("low_confidence_line_count", F.lit(0)).alias("low_confidence_line_count"),
        round_half_even(mean, 4).alias("mean_confidence"),
        chars.alias("meaningful_chars"),
    )


def normalized_boxes(images: DataFrame) -> DataFrame:
    """Image rectangles (x0, top, x1, bottom, width, height) clipped and scaled to their page."""
    box = norm_box(*[F.col(c) for c in ("x0", "top", "x1", "bottom", "width", "height")])
    return images.withColumn("_box", box).filter("_box IS NOT NULL").select(*PAGE, "_box.*")


def image_area(boxes: DataFrame) -> DataFrame:
    """Images and their share of the page, at most 1."""
    area = box_area(F.struct("x0", "y0", "x1", "y1"))
    return boxes.groupBy(*PAGE).agg(
        F.count("*").alias("image_count"),
        round_half_even(F.least(F.lit(1.0), F.sum(area)), 4).alias("image_area_ratio"),
    )


def ocr_candidates(boxes: DataFrame, min_area: float = MIN_IMAGE_AREA) -> DataFrame:
    """Pages with at least one image big enough for OCR."""
    area = box_area(F.struct("x0", "y0", "x1", "y1"))
    large = boxes.filter(area >= min_area)
    return large.groupBy(*PAGE).agg(F.count("*").alias("ocr_image_count"))


def _pairs(text: str) -> Counter:
    return Counter(map("".join, zip(text, text[1:])))


def _ratio_within(matcher: SequenceMatcher, least: float) -> tuple[float, float]:
    """Bounds of the sequence ratio, as close as it takes to tell whether it is at least the threshold.

    Blocks are those of `SequenceMatcher.get_matching_blocks`, the widest gaps first; a gap adds no more than its shorter side.
    """
    total = len(matcher.a) + len(matcher.b)
    gaps = [(-min(len(matcher.a), len(matcher.b)), 0, len(matcher.a), 0, len(matcher.b))]
    found, left = 0, -gaps[0][0]
    while gaps and 2.0 * found / total < least <= 2.0 * (found + left) / total:
        size, a, end_a, b, end_b = heappop(gaps)
        left += size
        i, j, k = matcher.find_longest_match(a, end_a, b, end_b)
        found += k
        for a1, a2, b1, b2 in ((a, i, b, j), (i + k, end_a, j + k, end_b)) if k else ():
            if a1 < a2 and b1 < b2:
                heappush(gaps, (-min(a2 - a1, b2 - b1), a1, a2, b1, b2))
                left += min(a2 - a1, b2 - b1)
    return 2.0 * found / total, 2.0 * (found + left) / total


@dataclass
class _Texts:
    """Comparisons of the keys of one page; what was found out about a key or a pair is kept."""

    bags: dict[str, tuple[Counter, Counter]] = field(default_factory=dict)
    ratios: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    matcher: SequenceMatcher = field(default_factory=SequenceMatcher)

    def alike(self, a: str, b: str, least: float) -> bool:
        """Near containment or a sequence ratio of at least the threshold; cheap upper bounds first.

        With c letter pairs in common, M matched characters obey c >= 3M - n - 1 (see
        `_similar_pairs`), which bounds the ratio 2M / n.
        """
        shorter, longer = sorted((len(a), len(b)))
        if shorter < 3:
            return False
        if b in a and longer <= round(shorter * NEAR_CONTAINED):
            return True
        total = shorter + longer
        if 2 * shorter / total < least:
            return False
        low, high = self.ratios.get((a, b), (0.0, 1.0))
        if low < least <= high:
            for text in (a, b):
                if text not in self.bags:
                    self.bags[text] = Counter(text), _pairs(text)
            letters, pairs = (sum((x & y).values()) for x, y in zip(self.bags[a], self.bags[b]))
            if 2.0 * letters / total < least or 2 * (pairs + total + 1) < 3 * total * least:
                return False
            if self.matcher.b != b:
                self.matcher.set_seq2(b)
            self.matcher.set_seq1(a)
            low, high = self.ratios[a, b] = _ratio_within(self.matcher, least)
        return low >= least


@F.pandas_udf(T.BooleanType())
def _similar(candidate: pd.Series, reference: pd.Series, threshold: pd.Series) -> pd.Series:
    """`_Texts.alike` of each row."""
    return pd.Series([_Texts().alike(*row) for row in zip(candidate, reference, threshold)], dtype=bool)


# Not to be pushed below a distinct, where it would run once per duplicate.
_similar = _similar.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bigrams(keys: pd.Series) -> pd.Series:
    """Letter pairs with their occurrence number, so that a bag becomes a set."""

    def bag(key: str) -> list[str]:
        seen: dict[str, int] = {}
        out = []
        for pair in map("".join, zip(key, key[1:])):
            seen[pair] = seen.get(pair, 0) + 1
            out.append(f"{pair}{seen[pair]}")
        return out

    return keys.map(bag)


def _first_pairs(often: dict[str, int], least: float) -> Callable[[Column], Column]:
    """The letter pairs that a key must share one of with any key of the ratio: its rarest, as many as are not surely shared."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def first(keys: pd.Series) -> pd.Series:
        def rarest(key: str) -> list[str]:
            seen: Counter = Counter()
            bag = []
            for pair in map("".join, zip(key, key[1:])):
                seen[pair] += 1
                bag.append((often.get(pair, 0) / seen[pair], f"{pair}{seen[pair]}"))
            size = len(key)
            shared = max(1, math.ceil(size * (2 / (2 - least)) * (1.5 * least - 1) - 1 - 1e-9))
            return [name for _, name in sorted(bag)[: size - shared]]

        return keys.map(rarest)

    return first


def _similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """All (page, key, other) that may reach the ratio, found without pairing up pages.

    Two keys of ratio r and total length n match in M = r n / 2 characters, in at most n - 2M + 1
    runs, so they share at least 3M - n - 1 letter pairs. Both must then share one of their first
    (pairs - shared + 1) pairs in any common order; those that are rare in the native text come first.
    The order is fixed beforehand by the `FREQUENT_PAIRS` most frequent ones, so that only first pairs are shuffled.
    """

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.length("key") >= 3).withColumn(name, F.xxhash64(*PAGE, "key"))

    left, right = named(left, "id"), named(right, "other_id")
    bags = right.select(F.explode(_bigrams("key")).alias("pair"))
    counts = bags.groupBy(F.left("pair", F.lit(2)).alias("pair")).count().orderBy(F.desc("count"), "pair").limit(FREQUENT_PAIRS)
    first = _first_pairs({x["pair"]: x["count"] for x in counts.collect()}, least)

    def tokens(df: DataFrame, name: str, size: str) -> DataFrame:
        # The key and its page stay behind: their tokens carry a digest and the length.
        exploded = df.select(*PAGE, name, F.length("key").alias(size), F.explode(first(F.col("key"))).alias("_pair"))
        return exploded.select(F.xxhash64(*PAGE, "_pair").alias("_meet"), name, size)

    short, total = F.least("size", "other_size"), F.col("size") + F.col("other_size")
    pairs = (
        tokens(left, "id", "size")
        .join(tokens(right, "other_id", "other_size").hint("merge"), "_meet")
        .filter(2 * short / total >= least)
        .select("id", "other_id")
        .distinct()
    )
    others = right.select(*PAGE, "other_id", F.col("key").alias("other"))
    return pairs.join(left.select(*PAGE, "id", "key"), "id").join(others, [*PAGE, "other_id"]).select(*PAGE, "key", "other")


def native_keys(lines: DataFrame, native: DataFrame) -> DataFrame:
    """Distinct (page, key) of OCR lines whose text also occurs natively on the page.

    Cheap rules first, each on what the previous one left: equal keys, keys inside a native line,
    and only then the sequence ratio.
    """
    keys = lines.filter("key <> ''").select(*PAGE, "key").distinct()
    known = native.filter("key <> ''").select(*PAGE, "key").distinct()
    equal = keys.join(known, [*PAGE, "key"], "left_semi")
    rest = keys.join(known, [*PAGE, "key"], "left_anti")
    hay = known.withColumnRenamed("key", "other")
    needles = rest.filter(F.length("key") >= 3)
    inside = containing(needles, hay, PAGE, "key", ["other"], whole=8).select(*PAGE, "key").distinct()
    rest = needles.join(inside, [*PAGE, "key"], "left_anti")
    pairs = _similar_pairs(rest, known, SIMILAR)
    alike = pairs.filter(_similar("key", "other", F.lit(SIMILAR))).select(*PAGE, "key").distinct()
    return equal.unionByName(inside).unionByName(alike)


def native_in_box(lines: DataFrame, native: DataFrame) -> DataFrame:
    """Distinct (page, idx) of lines centred in a native line's box whose text is fairly similar.

    Lines and boxes meet in grid cells of the page.
    """
    boxes = with_cells(native.filter("key <> ''").select(*PAGE, "key", "x0", "y0", "x1", "y1"), NATIVE_PAD)
    boxes = boxes.withColumnRenamed("key", "other")
    placed = lines.filter("cx IS NOT NULL AND key <> ''").select(
        *PAGE, "idx", "key", "cx", "cy",
        grid_cell(F.col("cx")).alias("_gx"), grid_cell(F.col("cy")).alias("_gy"),
    )
    near = placed.join(boxes.hint("merge"), [*PAGE, "_gx", "_gy"]).filter(
        point_in_box(
            F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")),
            F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), NATIVE_PAD,
        )
    )
    pairs = near.select(*PAGE, "idx", "key", "other").distinct()
    return pairs.filter(_similar("key", "other", F.lit(SIMILAR_IN_BOX))).select(*PAGE, "idx").distinct()


def keyed_lines(lines: DataFrame) -> DataFrame:
    """Prepared lines with their comparison key and centre (`cx`, `cy`).

    Lines also hold page_width and page_height in the units of their boxes.
    """
    point = centre(F.col("box"), F.col("page_width"), F.col("page_height"))
    rows = prepared_lines(lines).withColumn("key", match_key("text")).withColumn("_c", point)
    return rows.withColumn("cx", F.col("_c.x")).withColumn("cy", F.col("_c.y")).drop("_c")


def _reasons_of_long_pages(lines: DataFrame, native: DataFrame, images: DataFrame) -> DataFrame:
    """`line_reasons` of pages of any size: rule by rule, each of them spread over many tasks."""
    # Several rules read the keys, and computing them needs Python: once is enough.
    keyed = materialized(keyed_lines(lines))
    native = materialized(native.select(*PAGE, "key", "x0", "y0", "x1", "y1"))
    slim = keyed.select(*PAGE, "idx", "key", "cx", "cy")
    by_text = native_keys(slim, native).withColumn("_text", F.lit(True))
    by_box = native_in_box(slim, native).withColumn("_boxed", F.lit(True))
    with_images = images.select(*PAGE).distinct().withColumn("_images", F.lit(True))
    inside = in_any_box(slim, images, PAGE, IMAGE_PAD).select(*PAGE, "idx").withColumn(
        "_inside", F.lit(True)
    )
    flagged = (
        keyed.join(by_text, [*PAGE, "key"], "left")
        .join(by_box, [*PAGE, "idx"], "left")
        .join(inside, [*PAGE, "idx"], "left")
        .join(with_images, PAGE, "left")
    )
    reason = (
        F.when(F.col("_text") | F.col("_boxed"), "native")
        .when(F.col("_images") & F.col("_inside").isNull(), "outside")
        .otherwise("open")
    )
    judged = flagged.withColumn("reason", reason).drop("_text", "_boxed", "_inside", "_images")
    # First remaining line per key: a minimum, aggregated before the shuffle.
    at = F.struct("band", "left", "idx")
    firsts = (
        judged.filter("reason = 'open' AND key <> ''")
        .groupBy(*PAGE, "key")
        .agg(F.min(at).alias("_first"))
    )
    repeated = F.col("_first").isNotNull() & (F.col("_first") < at)
    return (
        judged.join(firsts, [*PAGE, "key"], "left")
        .withColumn(
            "reason",
            F.when(F.col("reason") != "open", F.col("reason"))
            .when(repeated, "duplicate")
            .otherwise("kept"),
        )
        .drop("_first")
    )


@dataclass
class _Page:
    """What a task looks at of one page: rows of lines as (place, key, idx, order, point), of native text as (key, box), and image boxes."""

    lines: list[tuple] = field(default_factory=list)
    native: list[tuple] = field(default_factory=list)
    images: list[tuple] = field(default_factory=list)

    @staticmethod
    def holds(box: tuple, point: tuple, pad: float) -> bool:
        x0, y0, x1, y1 = box
        return x0 - pad <= point[0] <= x1 + pad and y0 - pad <= point[1] <= y1 + pad

    def native_keys(self, texts: _Texts) -> set[str]:
        """Keys that also occur natively: equal, inside a native key, or of the ratio."""
        known = dict.fromkeys(k for k, _ in self.native)
        keys = dict.fromkeys(k for _, k, *_ in self.lines if k)
        found = {k for k in keys if k in known or len(k) >= 3 and any(k in other for other in known)}
        rest = [k for k in keys if k not in found and len(k) >= 3]
        for other in known:
            alike = {k for k in rest if texts.alike(k, other, SIMILAR)}
            found |= alike
            rest = [k for k in rest if k not in alike]
        return found

    def native_places(self, texts: _Texts, found: set[str]) -> set:
        """Indices of lines centred in the box of a native line of fairly similar text; `found` keys need no look."""
        placed = [(k, idx, point) for _, k, idx, _, point in self.lines if k and idx is not None and point]
        hits: set = set()
        # A line of a key that is native anyway counts for others of its index.
        shared = {i for i, n in Counter(idx for _, _, idx, _, _ in self.lines).items() if n > 1}
        for other, box in self.native:
            for k, idx, point in placed if box else ():
                if idx in hits or k in found and idx not in shared:
                    continue
                if self.holds(box, point, NATIVE_PAD) and texts.alike(k, other, SIMILAR_IN_BOX):
                    hits.add(idx)
        return hits

    def reasons(self) -> Iterator[tuple[int, str]]:
        """(place, reason) of each line; as often as lines of its index lie in an image, once at least."""
        texts = _Texts()
        by_text = self.native_keys(texts) if self.native else set()
        by_box = self.native_places(texts, by_text) if self.native else set()
        boxes = [x for x in self.images if x]
        inside = Counter(
            idx for _, _, idx, _, point in self.lines
            if idx is not None and point and any(self.holds(x, point, IMAGE_PAD) for x in boxes)
        )
        judged, firsts = [], {}
        for place, key, idx, order, _ in self.lines:
            if key in by_text or idx in by_box:
                reason = "native"
            elif self.images and not inside[idx]:
                reason = "outside"
            else:
                reason = "open"
                if key and (key not in firsts or order < firsts[key]):
                    firsts[key] = order
            judged.append((place, key, idx, order, reason))
        for place, key, idx, order, reason in judged:
            if reason == "open":
                reason = "duplicate" if key and firsts[key] < order else "kept"
            for _ in range(max(1, inside[idx])):
                yield place, reason


#: Kinds of rows that meet on a page.
LINE, NATIVE, IMAGE = 0, 1, 2
_BOX = ("_x0", "_y0", "_x1", "_y1")


def _judge_pages(columns: Sequence[str]):
    """Judges rows that come sorted by page; only the rows of the open page are carried on."""

    def judge(rows: pa.Table) -> pa.RecordBatch:
        at = {c: rows.column(c).to_pylist() for c in ("_kind", *PAGE, "idx", "_text", "cx", "cy", "band", "left", *_BOX)}
        boxes = [None if None in box else box for box in zip(*(at[c] for c in _BOX))]
        points = [None if None in point else point for point in zip(at["cx"], at["cy"])]
        orders = [tuple((x is not None, x) for x in order) for order in zip(at["band"], at["left"], at["idx"])]
        keys = [text_key(text) if kind == LINE else text for kind, text in zip(at["_kind"], at["_text"])]
        places, reasons = [], []
        page, open_page = _Page(), None

        def close() -> None:
            for place, reason in page.reasons():
                places.append(place)
                reasons.append(reason)

        for place, (kind, *of) in enumerate(zip(at["_kind"], *(at[c] for c in PAGE))):
            if of != open_page or None in of:
                close()
                page, open_page = _Page(), of
            if kind == LINE:
                page.lines.append((place, keys[place], at["idx"][place], orders[place], points[place]))
            elif kind == NATIVE:
                page.native.append((keys[place], boxes[place]))
            else:
                page.images.append(boxes[place])
        close()
        taken = rows.select([c for c in columns if c not in ("key", "reason")]).take(pa.array(places, pa.int64()))
        made = {"key": pa.array([keys[k] for k in places], pa.string()), "reason": pa.array(reasons, pa.string())}
        arrays = [made[c] if c in made else taken.column(c).combine_chunks() for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            rows = new if held is None else pa.concat_tables([held, new])
            last = [rows.column(c)[-1].as_py() for c in PAGE]
            begin = rows.num_rows - 1
            if None not in last:  # rows without a page are pages of their own
                same = np.ones(rows.num_rows, bool)
                for c, value in zip(PAGE, last):
                    same &= pc.fill_null(pc.equal(rows.column(c), pa.scalar(value, rows.column(c).type)), False).to_numpy()
                begin -= int(np.argmin(same[::-1])) - 1 if not same.all() else begin
            held = rows.slice(begin)
            if begin:
                yield judge(rows.slice(0, begin))
        if held is not None:
            yield judge(held)

    return run


def _reasons_by_page(lines: DataFrame, native: DataFrame, images: DataFrame) -> DataFrame:
    """`line_reasons` of pages that a task can look at as a whole: all rows of a page are shuffled to it once."""
    point = centre(F.col("box"), F.col("page_width"), F.col("page_height"))
    rows = prepared_lines(lines).withColumn("_c", point)
    rows = rows.select(*[c for c in rows.columns if c != "_c"], F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"))
    given = rows.withColumn("key", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    kept = [*PAGE, "key", "idx", *[c for c in given.columns if c not in (*PAGE, "key", "idx")]]
    corners = [F.col(c[1:]).cast("double").alias(c) for c in _BOX]
    none = [F.lit(None).cast("double").alias(c) for c in _BOX]
    # Lines travel without their key, which is made from their text where they meet.
    met = (
        rows.select(F.lit(LINE).alias("_kind"), F.col("text").alias("_text"), *none, *[c for c in rows.columns if c != "text"])
        .unionByName(native.filter("key <> ''").select(F.lit(NATIVE).alias("_kind"), *PAGE, F.col("key").alias("_text"), *corners), True)
        .unionByName(images.select(F.lit(IMAGE).alias("_kind"), *PAGE, *corners), True)
    )
    whole = F.col("doc_id").isNotNull() & F.col("page").isNotNull()
    spread = F.when(~whole, F.xxhash64("_text", "idx"))  # lines without a page meet nothing
    sorted_rows = met.repartition(*PAGE, spread).sortWithinPartitions(*PAGE)
    kinds = {f.name: f.dataType for f in met.schema.fields} | {c: T.StringType() for c in ("text", "key", "reason")}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in kept])
    judged = sorted_rows.withColumn("text", F.col("_text")).mapInArrow(_judge_pages(kept), schema)
    return judged.select(*[F.col(c).cast(given.schema[c].dataType).alias(c) for c in kept])


def _long_pages(lines: DataFrame, native: DataFrame, images: DataFrame) -> DataFrame:
    """Pages of more rows or characters than a task looks at together."""
    parts = [lines.select(*PAGE, F.length("text").cast("long").alias("_chars")), *(x.select(*PAGE, F.lit(0).cast("long").alias("_chars")) for x in (native, images))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).dropna(subset=PAGE)
    sizes = rows.groupBy(*PAGE).agg(F.count("*").alias("_rows"), F.sum("_chars").alias("_chars"))
    return sizes.filter((F.col("_rows") > PAGE_ROWS) | (F.col("_chars") > PAGE_CHARS)).select(*PAGE)


def line_reasons(lines: DataFrame, native: DataFrame, images: DataFrame) -> DataFrame:
    """Every prepared line with its fate: native, outside, duplicate or kept, in that order.

    `outside` applies only to pages that have images; a repeated key is a duplicate of the first
    remaining line in reading order; lines without a key are never duplicates. Pages meet their native
    text and images in one shuffle; long ones, if there are any, go rule by rule.
    """
    long = materialized(_long_pages(lines, native, images))
    if long.isEmpty():
        return _reasons_by_page(lines, native, images)
    short = [x.join(long, PAGE, "left_anti") for x in (lines, native, images)]
    rest = [x.join(long, PAGE, "left_semi") for x in (lines, native, images)]
    return _reasons_by_page(*short).unionByName(_reasons_of_long_pages(*rest))


def drop_native_lines(lines: DataFrame, native: DataFrame, images: DataFrame) -> DataFrame:
    """The lines that only images hold."""
    return line_reasons(lines, native, images).filter("reason = 'kept'").drop("reason")


def ocr_filter_counts(judged: DataFrame) -> DataFrame:
    """Raw, native, outside-image, duplicate and kept lines per page from `line_reasons`."""

    def of(name: str) -> Column:
        return F.count_if(F.col("reason") == name)

    return judged.groupBy(*PAGE).agg(
        F.count("*").alias("raw_ocr_line_count"),
        of("native").alias("filtered_native_line_count"),
        of("outside").alias("filtered_outside_image_line_count"),
        of("duplicate").alias("filtered_duplicate_line_count"),
        of("kept").alias("image_line_count"),
    )


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """Keep the first line per key and page in reading order; lines without a key all stay."""
    keyed = lines.filter("key <> ''")
    return dedupe_first(keyed, [*PAGE, "key"], ["band", "left", "idx"]).unionByName(
        lines.filter("key = '' OR key IS NULL")
    )


def _line_starts(hard: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Where lines start: at `hard` starts, and in between at a top too far from the mean of its line."""
    firsts = np.flatnonzero(hard)
    heights = np.maximum.reduceat(tops, firsts) - np.minimum.reduceat(tops, firsts)
    ends = np.append(firsts[1:], len(tops))
    starts = [firsts]
    for k in np.flatnonzero(heights > LINE_GAP).tolist():
        total, count, soft = 0.0, 0, []
        for at, top in enumerate(tops[firsts[k] : ends[k]].tolist(), start=int(firsts[k])):
            if count and abs(top - total / count) > LINE_GAP:
                soft.append(at)
                total, count = 0.0, 0
            total += top
            count += 1
        starts.append(np.array(soft, np.int64))
    return np.sort(np.concatenate(starts))


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of words that come sorted by page and place; only the words of the open line are carried on."""
    held: pa.Table | None = None
    island = line = 0  # of the open line

    def lines(words: pa.Table, more: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        nonlocal island, line
        column = {c: words.column(c).combine_chunks() for c in words.column_names}
        band, top = column["band"].to_numpy(), column["top"].to_numpy()
        other = np.ones(len(band), bool)
        apart = np.concatenate(([False], np.diff(band) >= 3))
        other[1:] = False
        for c in PAGE:
            code = column[c].dictionary_encode(null_encoding="encode").indices.to_numpy()
            other[1:] |= code[1:] != code[:-1]
        starts = _line_starts(other | apart, top)
        # Islands and lines count on from those of the open line.
        page = np.cumsum(other[starts]) - 1
        jump = np.cumsum((apart & ~other)[starts])
        first_of_page = np.flatnonzero(other[starts])
        islands = jump - jump[first_of_page][page] + np.where(page == 0, island, 0)
        fresh = other[starts] | apart[starts]
        fresh[0] = True
        group = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        numbers = np.arange(len(starts)) - group + np.where(group == 0, line, 0)
        if more:
            done, island, line = len(starts) - 1, int(islands[-1]), int(numbers[-1])
            rest = words.slice(int(starts[-1]))
            words, starts = words.slice(0, int(starts[-1])), starts[:-1]
            if not done:
                return None, rest
        else:
            done, rest = len(starts), None
        n = len(words)
        number = np.repeat(np.arange(done), np.diff(np.append(starts, n)))
        left = column["x0"].fill_null(-np.inf).to_numpy()[:n]
        order = np.lexsort((column["idx"].to_numpy()[:n], band[:n], left, number))
        texts = column["text"].slice(0, n).fill_null("").take(pa.array(order)).to_pylist()
        bounds = [*starts.tolist(), n]
        text = [" ".join(texts[a:b]) for a, b in zip(bounds, bounds[1:])]
        edges = []
        for c, pick in (("x0", np.fmin), ("top", np.fmin), ("x1", np.fmax), ("bottom", np.fmax), ("width", np.fmax), ("height", np.fmax)):
            values = pick.reduceat(column[c].to_numpy(zero_copy_only=False)[:n], starts)
            edges.append(pa.array(values, pa.float64(), from_pandas=True))
        at = pa.array(starts)
        fields = [*PAGE, "island", "line", "text", "x0", "top", "x1", "bottom", "width", "height"]
        arrays = [*(column[c].take(at) for c in PAGE), pa.array(islands[:done], pa.int64()), pa.array(numbers[:done], pa.int32()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays([*arrays, *edges], names=fields), rest

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        out, held = lines(new if held is None else pa.concat_tables([held, new]), True)
        if out is not None:
            yield out
    if held is not None:
        yield lines(held, False)[0]


def group_words(words: DataFrame) -> DataFrame:
    """Words (doc_id, page, idx, text, x0, top, x1, bottom, width, height) as native lines.

    Words are taken in the order of bands of 2.5 units, then from left to right; a word whose top is
    more than the line gap from the mean top of the open line begins a new one. Bands apart by three or
    more begin a new island of lines. Words are shuffled once, by page, and sorted; each task then
    passes over them in Arrow batches and holds no more than the open line, whatever the size of a page.
    """
    rows = words.filter(F.col("top").isNotNull()).withColumn("band", F.bround(F.col("top") / WORD_BAND).cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in words.schema.fields}
    boxes = ("x0", "top", "x1", "bottom", "width", "height")
    slim = rows.select(
        *PAGE, "band", F.col("x0").cast("double"), "idx", *[F.col(c).cast("double") for c in ("top", "x1", "bottom")], "text",
        *[F.col(c).cast("double") for c in ("width", "height")],
    )
    ordered = slim.repartition(*PAGE).sortWithinPartitions(*PAGE, "band", "x0", "idx")
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in PAGE), "island long, line int, text string", *(f"{c} double" for c in boxes)])
    lines = ordered.mapInArrow(_scan_lines, schema)
    box = norm_box(*[F.col(c) for c in boxes])
    keyed = lines.select(*PAGE, "island", "line", clean_lines(F.col("text")).alias("text"), box.alias("_box"))
    keyed = keyed.withColumn("key", match_key("text"))
    return keyed.filter("key <> '' AND _box IS NOT NULL").select(*PAGE, "island", "line", "text", "key", "_box.*")
