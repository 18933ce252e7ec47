"""OCR reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Registry
from parlance import fixtures as fx
from parlance.functions import text
from parlance.functions.boxes import centre
from parlance.operators import ocr as op
from parlance.operators.matching import in_any_box

REG = Registry()
QUERIES, ORACLE = REG.queries, REG.oracle


@REG.add(
    "reading_order",
    f"""WITH {fx.OCR_SQL} SELECT doc_id, page, idx, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, "left", idx) AS position,
      clean AS text FROM lines WHERE clean <> ''""",
)
def _reading(spark, sf_dir):
    rows = op.reading_order(fx.ocr_lines(spark, sf_dir))
    return rows.select("doc_id", "page", "idx", "position", "text")


@REG.add(
    "ocr_page_summary",
    f"""WITH {fx.OCR_SQL}, w AS (SELECT *, greatest(1, length(replace(clean, ' ', ''))) AS w,
        length(regexp_replace(clean, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS a FROM lines WHERE clean <> ''),
    s AS (SELECT doc_id, page, count(*) AS line_count, count(*) FILTER (confidence < 0.6) AS low_confidence_line_count,
      sum(confidence * w) / sum(w) AS m, CAST(sum(a) AS BIGINT) AS meaningful_chars FROM w GROUP BY 1, 2)
    SELECT doc_id, page, CASE WHEN meaningful_chars < 5 THEN 'sparse' WHEN m < 0.6 THEN 'low_confidence' ELSE 'good' END AS status,
      line_count, low_confidence_line_count, round_even(m, 4) AS mean_confidence, meaningful_chars FROM s""",
)
def _summary(spark, sf_dir):
    return op.ocr_page_summary(op.prepared_lines(fx.ocr_lines(spark, sf_dir)))


@REG.add(
    "clean_lines",
    r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(trim(x, ' ' || chr(10) || chr(13) || chr(9)), chr(0), ''), '\r\n?', chr(10), 'g'), chr(10)),
      lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), lambda l: l <> ''), chr(10))) AS digest
    FROM (SELECT doc_id, chr(9) || replace(text, '. ', '.  ' || chr(9) || chr(13)) || ' ' || chr(10) AS x FROM documents)""",
)
def _clean(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(chr(9), replace(text, '. ', concat('.  ', chr(9), chr(13))), ' ', chr(10)) AS x"
    )
    return rows.select("doc_id", F.md5(text.clean_lines(F.col("x"))).alias("digest"))


@REG.add(
    "match_key",
    r"""SELECT doc_id, md5(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+', '', 'g')) AS digest FROM documents""",
)
def _match_key(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.md5(text.match_key("text")).alias("digest"))


@REG.add(
    "normalized_boxes",
    f"""WITH {fx.PARAGRAPHS_SQL}, {fx.IMAGES_SQL} SELECT doc_id, page, round(x0, 9) AS x0, round(y0, 9) AS y0, round(x1, 9) AS x1, round(y1, 9) AS y1 FROM boxes""",
)
def _boxes(spark, sf_dir):
    rows = op.normalized_boxes(fx.images(spark, sf_dir))
    return rows.select("doc_id", "page", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@REG.add(
    "image_area",
    f"""WITH {fx.PARAGRAPHS_SQL}, {fx.IMAGES_SQL} SELECT doc_id, page, count(*) AS image_count,
      round_even(least(1.0, sum((x1 - x0) * (y1 - y0))), 4) AS image_area_ratio FROM boxes GROUP BY 1, 2""",
)
def _area(spark, sf_dir):
    return op.image_area(op.normalized_boxes(fx.images(spark, sf_dir)))


@REG.add(
    "ocr_candidates",
    f"""WITH {fx.PARAGRAPHS_SQL}, {fx.IMAGES_SQL} SELECT doc_id, page, count(*) AS ocr_image_count FROM boxes
    WHERE (x1 - x0) * (y1 - y0) >= 0.015 GROUP BY 1, 2""",
)
def _candidates(spark, sf_dir):
    return op.ocr_candidates(op.normalized_boxes(fx.images(spark, sf_dir)))


_INSIDE_SQL = f"""{fx.OCR_SQL}, {fx.IMAGES_SQL},
inside AS (SELECT DISTINCT l.doc_id, l.page, l.idx FROM lines l JOIN boxes b ON b.doc_id = l.doc_id AND b.page = l.page AND l.boxed
  AND (l.bx + 100) / 1000 BETWEEN b.x0 - 0.005 AND b.x1 + 0.005
  AND (round_even(l.by_, 2) + round_even(l.by_, 2) + round_even(l.by_ + 40, 2) + round_even(l.by_ + 40, 2)) / 4 / 1400 BETWEEN b.y0 - 0.005 AND b.y1 + 0.005)"""


@REG.add("in_any_box", f"WITH {_INSIDE_SQL} SELECT * FROM inside")
def _in_box(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    boxes = op.normalized_boxes(fx.images(spark, sf_dir))
    return in_any_box(rows, boxes, op.PAGE).select("doc_id", "page", "idx")


@REG.add(
    "outside_all_boxes",
    f"""WITH {_INSIDE_SQL} SELECT doc_id, page, idx FROM lines WHERE (doc_id, page, idx) NOT IN (SELECT (doc_id, page, idx) FROM inside)""",
)
def _out_box(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    boxes = op.normalized_boxes(fx.images(spark, sf_dir))
    return in_any_box(rows, boxes, op.PAGE, inside=False).select("doc_id", "page", "idx")


def _placed(spark, sf_dir):
    rows = op.prepared_lines(fx.ocr_lines(spark, sf_dir))
    rows = rows.withColumn("c", centre(F.col("box"), F.col("page_width"), F.col("page_height")))
    return rows.select("doc_id", "page", "idx", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@REG.add("line_reasons")
def _reasons(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "page", "idx", "reason")


def _judged(spark, sf_dir):
    return op.line_reasons(
        fx.ocr_lines(spark, sf_dir), fx.native_lines(spark, sf_dir),
        op.normalized_boxes(fx.images(spark, sf_dir)),
    )


@REG.add("ocr_filter_counts")
def _counts(spark, sf_dir):
    return op.ocr_filter_counts(_judged(spark, sf_dir))


@REG.add("drop_native_lines")
def _kept(spark, sf_dir):
    kept = op.drop_native_lines(
        fx.ocr_lines(spark, sf_dir), fx.native_lines(spark, sf_dir),
        op.normalized_boxes(fx.images(spark, sf_dir)),
    )
    return kept.select("doc_id", "page", "idx", "text", "confidence")


@REG.add(
    "dedupe_first",
    """SELECT l_partkey, l_returnflag, min(l_orderkey) AS l_orderkey, arg_min(l_shipdate, (l_orderkey, l_linenumber, l_suppkey))::VARCHAR AS shipped
    FROM lineitem GROUP BY 1, 2""",
)
def _dedupe(spark, sf_dir):
    from parlance.operators.ordered import dedupe_first

    rows = fx.table(spark, sf_dir, "lineitem")
    first = dedupe_first(
        rows, ["l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_suppkey"]
    )
    return first.select(
        "l_partkey", "l_returnflag", "l_orderkey", F.col("l_shipdate").cast("string").alias("shipped")
    )


@REG.add(
    "group_words",
    """WITH w AS (SELECT doc_id, i - 1 AS pos, items[i] AS t FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS items FROM documents),
      unnest(range(1, len(items) + 1)) AS r(i)),
    l AS (SELECT doc_id, CAST(1 + pos // 200 AS INTEGER) AS page, pos % 200 // 10 AS nth, string_agg(t, ' ' ORDER BY 20 + (pos % 10) * 55 + pos % 3) AS text,
      min(20 + (pos % 10) * 55 + pos % 3) AS x0, max(70 + (pos % 10) * 55) AS x1 FROM w GROUP BY 1, 2, 3)
    SELECT doc_id, page, text, round(x0 / 600.0::DOUBLE, 6) AS x0, round(x1 / 600.0::DOUBLE, 6) AS x1 FROM l
    WHERE regexp_matches(text, '[\\p{L}\\p{N}]')""",
)
def _group(spark, sf_dir):
    rows = op.group_words(fx.words(spark, sf_dir))
    return rows.select(
        "doc_id", "page", "text", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1")
    )
