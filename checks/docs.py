"""Page text and page table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Registry
from parlance import fixtures as fx
from parlance.functions import pages as pg
from parlance.operators import batches
from parlance.operators import pages as op
from parlance.plans.page_text import page_text

REG = Registry()
QUERIES, ORACLE = REG.queries, REG.oracle

_CLEAN = r"'[\x09-\x0d\x1c-\x20\x{85}\x{a0}\p{Z}]+'"
QUALITY_SQL = rf"""{fx.PAGE_CANDIDATES_SQL},
counted AS (SELECT *, length(regexp_replace(text, {_CLEAN}, '', 'g')) AS visible_chars,
    length(regexp_replace(regexp_replace(text, '(?im)^\s*\d+\s*(?:of|/)\s*\d+\s*$', '', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')) AS meaningful_chars,
    len(regexp_extract_all(text, '(?i)\(cid:\d+\)')) AS cid_tokens,
    length(text) - length(replace(text, chr(65533), '')) AS replacement_chars,
    len(regexp_extract_all(text, '[\x{{2E80}}-\x{{2FDF}}]')) AS radical_chars,
    len(regexp_extract_all(text, '[\x00-\x08\x0b\x0e-\x1f]')) AS control_chars FROM cands),
judged AS (SELECT *, visible_chars > 0 AND (cid_tokens >= 3 OR cid_tokens / visible_chars >= 0.01) AS b1,
    visible_chars > 0 AND (replacement_chars >= 3 OR replacement_chars / visible_chars >= 0.01) AS b2,
    visible_chars > 0 AND (radical_chars >= 3 AND radical_chars / visible_chars >= 0.005) AS b3,
    visible_chars > 0 AND (control_chars >= 3 OR control_chars / visible_chars >= 0.01) AS b4 FROM counted),
staged AS (SELECT *, CASE WHEN visible_chars = 0 THEN 'empty' WHEN b1 OR b2 OR b3 OR b4 THEN 'poor'
    WHEN (image_coverage >= 0.5 AND meaningful_chars < 100) OR meaningful_chars < 20 THEN 'sparse' ELSE 'good' END AS status FROM judged),
scored AS (SELECT doc_id, page, engine, engine_order, text, image_coverage > 0 AS has_image, status,
    CAST(CASE status WHEN 'empty' THEN 0 WHEN 'sparse' THEN least(50, meaningful_chars * 2)
      ELSE 100 - least(100, cid_tokens * 8 + replacement_chars * 8 + radical_chars * 2 + control_chars * 4) END AS INTEGER) AS score,
    visible_chars, meaningful_chars, cid_tokens, replacement_chars, radical_chars, control_chars,
    concat_ws('|', CASE WHEN visible_chars = 0 THEN '未提取到可见文字' END,
      CASE WHEN visible_chars = 0 AND image_coverage > 0 THEN '页面包含图像对象' END,
      CASE WHEN b1 THEN '包含大量 (cid:...) 字体映射占位符' END, CASE WHEN b2 THEN '包含大量 Unicode 替换字符' END,
      CASE WHEN b3 THEN '包含疑似替代汉字的部首字符' END, CASE WHEN b4 THEN '包含异常控制字符' END,
      CASE WHEN status = 'sparse' THEN CASE WHEN image_coverage >= 0.5 AND meaningful_chars < 100 THEN '页面图像覆盖约 '
        || CAST(round_even(image_coverage * 100, 0) AS INTEGER) || '%，且可提取文字少于 100 个字符' ELSE '有效文字少于 20 个字符' END END) AS reasons
  FROM staged)"""
BEST_SQL = f"""{QUALITY_SQL},
whole AS (SELECT doc_id, min(engine_order) AS w FROM
  (SELECT doc_id, engine_order FROM scored GROUP BY 1, 2 HAVING bool_and(status = 'good')) GROUP BY 1),
best AS (SELECT s.* FROM scored s LEFT JOIN whole USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY coalesce(engine_order = w, false) DESC,
    CASE status WHEN 'empty' THEN 0 WHEN 'poor' THEN 1 WHEN 'sparse' THEN 2 ELSE 3 END DESC, score DESC, visible_chars DESC, engine_order) = 1)"""


def scored(spark, sf_dir):
    return op.with_quality(fx.page_candidates(spark, sf_dir))


@REG.add(
    "page_quality",
    f"""WITH {QUALITY_SQL} SELECT doc_id, page, engine, has_image, status, score, CAST(visible_chars AS INTEGER) AS visible_chars,
      CAST(meaningful_chars AS INTEGER) AS meaningful_chars, CAST(cid_tokens AS INTEGER) AS cid_tokens,
      CAST(replacement_chars AS INTEGER) AS replacement_chars, CAST(radical_chars AS INTEGER) AS radical_chars,
      CAST(control_chars AS INTEGER) AS control_chars, reasons FROM scored""",
)
def _quality(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select(
        "doc_id", "page", "engine", "has_image", "status", "score", *op.COUNTERS,
        F.array_join("reasons", "|").alias("reasons"),
    )


@REG.add(
    "doc_quality",
    f"""WITH {QUALITY_SQL} SELECT doc_id, engine, count(*) AS pages,
      CASE WHEN bool_and(status = 'good') THEN 'good' WHEN bool_or(status = 'good') THEN 'mixed'
        WHEN bool_and(status IN ('empty', 'sparse')) THEN 'empty' ELSE 'poor' END AS status,
      CAST(round_even(sum(score) / count(*), 0) AS INTEGER) AS score, CAST(sum(visible_chars) AS BIGINT) AS visible_chars,
      CAST(sum(meaningful_chars) AS BIGINT) AS meaningful_chars, CAST(sum(cid_tokens) AS BIGINT) AS cid_tokens,
      CAST(sum(replacement_chars) AS BIGINT) AS replacement_chars, CAST(sum(radical_chars) AS BIGINT) AS radical_chars,
      CAST(sum(control_chars) AS BIGINT) AS control_chars, count(*) FILTER (has_image) AS image_pages,
      count(*) FILTER (status = 'good') AS good_pages, count(*) FILTER (status <> 'good') AS suspect_pages
    FROM scored GROUP BY 1, 2""",
)
def _doc_quality(spark, sf_dir):
    return op.doc_quality(scored(spark, sf_dir), ["doc_id", "engine"])


@REG.add(
    "page_lists",
    f"""WITH {BEST_SQL} SELECT doc_id, page, 'image' AS list FROM best WHERE has_image UNION ALL
    SELECT doc_id, page, CASE WHEN status = 'good' THEN 'good' ELSE 'suspect' END FROM best""",
)
def _page_lists(spark, sf_dir):
    return op.page_lists(op.best_pages(scored(spark, sf_dir)))


@REG.add(
    "doc_reasons",
    f"""WITH {BEST_SQL}, r AS (SELECT doc_id, page, string_split(reasons, '|') AS items FROM best WHERE reasons <> '')
    SELECT doc_id, page, CAST(i - 1 AS INTEGER) AS nth, '第 ' || page || ' 页：' || items[i] AS message
    FROM r, unnest(range(1, len(items) + 1)) AS x(i)""",
)
def _doc_reasons(spark, sf_dir):
    return op.doc_reasons(op.best_pages(scored(spark, sf_dir)))


@REG.add(
    "best_pages",
    f"""WITH {BEST_SQL} SELECT doc_id, page, engine, status, score, text, CASE WHEN min(engine) OVER d = max(engine) OVER d
      THEN min(engine) OVER d ELSE 'hybrid' END AS doc_engine FROM best WINDOW d AS (PARTITION BY doc_id)""",
)
def _best(spark, sf_dir):
    chosen = op.best_pages(scored(spark, sf_dir))
    labels = op.engine_label(chosen).withColumnRenamed("engine", "doc_engine")
    return chosen.join(labels, "doc_id").select(
        "doc_id", "page", "engine", "status", "score", "text", "doc_engine"
    )


# Each step of the walk reads a page, a piece of one, or closes a batch.
_BUDGET, _PAGES = 1500, 6
_BATCH_SQL = f"""{BEST_SQL},
lens AS (SELECT doc_id, page, engine, status, text, status = 'good' AS usable, length(text) AS n FROM best),
walk AS (SELECT doc_id, 1 AS page, 0 AS cut_at, 0 AS batch, 0 AS used, 1 AS begun FROM lens WHERE page = 1 UNION ALL
  SELECT doc_id, CASE WHEN act IN ('empty', 'whole') THEN page + 1 ELSE page END,
    CASE act WHEN 'cut' THEN cut_at + {_BUDGET} - used WHEN 'empty' THEN 0 WHEN 'whole' THEN 0 ELSE cut_at END, CASE WHEN act IN ('empty', 'whole') THEN batch ELSE batch + 1 END,
    CASE act WHEN 'empty' THEN used WHEN 'whole' THEN used + n - cut_at ELSE 0 END, CASE WHEN act IN ('empty', 'whole') THEN begun ELSE page END
  FROM (SELECT w.*, l.n, CASE WHEN w.page >= begun + {_PAGES} THEN 'window' WHEN NOT usable THEN 'empty'
      WHEN {_BUDGET} - used > 0 AND n - cut_at <= {_BUDGET} - used THEN 'whole'
      WHEN {_BUDGET} - used > 0 AND (used = 0 OR {_BUDGET} - used >= least(500, n - cut_at)) THEN 'cut' ELSE 'skip' END AS act
    FROM walk w JOIN lens l ON l.doc_id = w.doc_id AND l.page = w.page)),
acts AS (SELECT w.*, l.n, usable, text, status, engine, CASE WHEN w.page >= begun + {_PAGES} THEN 'window' WHEN NOT usable THEN 'empty'
      WHEN {_BUDGET} - used > 0 AND n - cut_at <= {_BUDGET} - used THEN 'whole'
      WHEN {_BUDGET} - used > 0 AND (used = 0 OR {_BUDGET} - used >= least(500, n - cut_at)) THEN 'cut' ELSE 'skip' END AS act
    FROM walk w JOIN lens l ON l.doc_id = w.doc_id AND l.page = w.page),
starts AS (SELECT doc_id, batch, page, cut_at FROM acts WHERE act IN ('empty', 'whole', 'cut') AND page = begun)"""


@REG.add(
    "page_by_chars",
    f"""WITH RECURSIVE {_BATCH_SQL} SELECT a.doc_id, CAST(a.batch AS BIGINT) AS batch, a.page,
      CASE act WHEN 'whole' THEN substr(text, a.cut_at + 1) WHEN 'cut' THEN substr(text, a.cut_at + 1, {_BUDGET} - used) ELSE '' END AS text,
      CAST(n AS INTEGER) AS char_count, CASE WHEN usable THEN a.cut_at ELSE 0 END AS offset_start,
      CAST(CASE act WHEN 'whole' THEN n WHEN 'cut' THEN a.cut_at + {_BUDGET} - used ELSE 0 END AS INTEGER) AS offset_end, act <> 'cut' AS complete,
      usable AS usable_for_summary, status AS text_quality_status, engine AS extractor, coalesce(s.page, -1) AS next_page, coalesce(s.cut_at, 0) AS next_offset
    FROM acts a LEFT JOIN starts s ON s.doc_id = a.doc_id AND s.batch = a.batch + 1 WHERE act IN ('empty', 'whole', 'cut')""",
)
def _by_chars(spark, sf_dir):
    rows = page_text(fx.page_candidates(spark, sf_dir), _BUDGET, _PAGES)
    return rows.withColumn("next_page", F.coalesce("next_page", F.lit(-1)))


TABLES_SQL = """tables AS (SELECT o_custkey AS doc_id, CAST(1 + o_orderkey % 7 AS INTEGER) AS page,
  o_orderkey AS table_idx, CAST(o_orderkey * 7 % 900 AS INTEGER) AS cells FROM orders)"""


def page_tables(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS doc_id", "cast(1 + o_orderkey % 7 AS int) AS page",
        "o_orderkey AS table_idx", "cast(o_orderkey * 7 % 900 AS int) AS cells",
    )


# A step reads the table at hand, or begins a new batch with it; `begun` is the start page.
_TABLE_WALK_SQL = f"""{TABLES_SQL}, rows_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, table_idx) AS nth FROM tables),
  walk AS (SELECT doc_id, 1 AS nth, 0 AS batch, 0 AS held, 0 AS total, 1 AS begun FROM rows_ WHERE nth = 1 UNION ALL
    SELECT w.doc_id, CASE WHEN act = 'read' THEN w.nth + 1 ELSE w.nth END, CASE WHEN act = 'read' OR held = 0 THEN batch ELSE batch + 1 END,
      CASE WHEN act = 'read' THEN held + 1 ELSE 0 END, CASE WHEN act = 'read' THEN total + cells ELSE 0 END,
      CASE act WHEN 'read' THEN begun WHEN 'window' THEN begun + 5 * ((page - begun) // 5) ELSE page END
    FROM (SELECT w.*, page, cells, CASE WHEN page >= begun + 5 THEN 'window' WHEN held + 1 > 4 OR total + cells > 1500 THEN CASE WHEN held = 0 THEN 'error' ELSE 'stop' END
        ELSE 'read' END AS act FROM walk w JOIN rows_ r ON r.doc_id = w.doc_id AND r.nth = w.nth) w WHERE act <> 'error'),
  acts AS (SELECT w.*, page, table_idx, cells, CASE WHEN page >= begun + 5 THEN 'window' WHEN held + 1 > 4 OR total + cells > 1500
      THEN CASE WHEN held = 0 THEN 'error' ELSE 'stop' END ELSE 'read' END AS act FROM walk w JOIN rows_ r ON r.doc_id = w.doc_id AND r.nth = w.nth)"""


@REG.add(
    "page_by_tables",
    f"""WITH RECURSIVE {_TABLE_WALK_SQL} SELECT doc_id, page, table_idx, cells, CAST(batch AS BIGINT) AS batch FROM acts WHERE act = 'read'""",
)
def _by_tables(spark, sf_dir):
    return batches.batches_by_tables(page_tables(spark, sf_dir), 4, 1500)[0]


@REG.add(
    "page_by_tables_cursor",
    f"""WITH RECURSIVE {_TABLE_WALK_SQL}, s AS (SELECT doc_id, batch, min(begun) AS start_page, count(*) FILTER (act = 'read') AS table_count,
        CAST(coalesce(sum(cells) FILTER (act = 'read'), 0) AS BIGINT) AS cell_count, max(CASE WHEN act = 'error' THEN 'first_table_too_large' END) AS error,
        min(CASE WHEN act = 'error' THEN page END) AS bad_page, min(CASE WHEN act = 'error' THEN table_idx END) AS bad_table
      FROM acts WHERE act IN ('read', 'error') GROUP BY 1, 2),
    n AS (SELECT doc_id, batch, begun, page, table_idx FROM acts WHERE act IN ('read', 'error') AND held = 0)
    SELECT s.doc_id, CAST(s.batch AS BIGINT) AS batch, CAST(start_page AS BIGINT) AS start_page, table_count, cell_count,
      CAST(coalesce(CASE WHEN error IS NOT NULL THEN bad_page ELSE n.begun END, -1) AS INTEGER) AS next_page,
      coalesce(CASE WHEN error IS NOT NULL THEN bad_table WHEN n.page < start_page + 5 THEN n.table_idx WHEN n.page IS NOT NULL THEN 0 END, -1) AS next_table, error
    FROM s LEFT JOIN n ON n.doc_id = s.doc_id AND n.batch = s.batch + 1""",
)
def _by_tables_cursor(spark, sf_dir):
    cursor = batches.batches_by_tables(page_tables(spark, sf_dir), 4, 1500)[1]
    return cursor.fillna(-1, ["next_page", "next_table"])


_PARA_WALK_SQL = f"""{fx.PARAGRAPHS_SQL}, rows_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM paras),
  walk AS (SELECT doc_id, pos, text, nth, 0 AS batch, 1 AS held, length(text) AS total FROM rows_ WHERE nth = 1 UNION ALL
    SELECT r.doc_id, r.pos, r.text, r.nth, CASE WHEN held = 12 OR total + length(r.text) > 900 THEN batch + 1 ELSE batch END,
      CASE WHEN held = 12 OR total + length(r.text) > 900 THEN 1 ELSE held + 1 END,
      CASE WHEN held = 12 OR total + length(r.text) > 900 THEN length(r.text) ELSE total + length(r.text) END
    FROM walk w JOIN rows_ r ON r.doc_id = w.doc_id AND r.nth = w.nth + 1)"""


@REG.add(
    "page_by_paragraphs",
    f"""WITH RECURSIVE {_PARA_WALK_SQL} SELECT doc_id, pos, text, CAST(batch AS BIGINT) AS batch FROM walk""",
)
def _by_paragraphs(spark, sf_dir):
    return batches.batches_by_paragraphs(fx.paragraphs(spark, sf_dir), 12, 900)[0]


@REG.add(
    "page_by_paragraphs_cursor",
    f"""WITH RECURSIVE {_PARA_WALK_SQL}, b AS (SELECT doc_id, batch, count(*) AS paragraph_count, CAST(sum(length(text)) AS BIGINT) AS char_count, min(pos) AS pos
      FROM walk GROUP BY 1, 2)
    SELECT b.doc_id, CAST(b.batch AS BIGINT) AS batch, b.paragraph_count, b.char_count, coalesce(n.pos, -1) AS next_paragraph
    FROM b LEFT JOIN b n ON n.doc_id = b.doc_id AND n.batch = b.batch + 1""",
)
def _by_paragraphs_cursor(spark, sf_dir):
    cursor = batches.batches_by_paragraphs(fx.paragraphs(spark, sf_dir), 12, 900)[1]
    return cursor.withColumn("next_paragraph", F.coalesce("next_paragraph", F.lit(-1)))


@REG.add(
    "tables_by_cells",
    f"""WITH RECURSIVE {TABLES_SQL}, rows_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY table_idx) AS nth FROM tables),
    walk AS (SELECT doc_id, 1 AS nth, 0 AS batch, 0 AS held, 1200 AS room FROM rows_ WHERE nth = 1 UNION ALL
      SELECT w.doc_id, CASE WHEN held = 6 OR room <= 0 OR (cells > room AND held > 0) THEN w.nth ELSE w.nth + 1 END,
        CASE WHEN held = 6 OR room <= 0 OR cells > room THEN batch + 1 ELSE batch END,
        CASE WHEN held = 6 OR room <= 0 OR cells > room THEN 0 ELSE held + 1 END, CASE WHEN held = 6 OR room <= 0 OR cells > room THEN 1200 ELSE room - cells END
      FROM walk w JOIN rows_ r ON r.doc_id = w.doc_id AND r.nth = w.nth)
    SELECT w.doc_id, table_idx, CAST(batch AS BIGINT) AS batch, CAST(least(cells, room) AS BIGINT) AS used, cells > room AS truncated
    FROM walk w JOIN rows_ r ON r.doc_id = w.doc_id AND r.nth = w.nth WHERE held < 6 AND room > 0""",
)
def _by_cells(spark, sf_dir):
    rows = batches.batches_by_cells(page_tables(spark, sf_dir), 6, 1200)[0]
    return rows.select("doc_id", "table_idx", "batch", "used", "truncated")


@REG.add(
    "page_window",
    """WITH t AS (SELECT o_orderkey, CAST(o_custkey % 40 AS INTEGER) AS n, CAST(o_orderkey % 23 AS INTEGER) AS s,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 37 AS INTEGER) END AS e,
        CAST(o_orderkey % 6 AS INTEGER) AS m FROM orders),
    c AS (SELECT *, coalesce(e, n) AS w, CASE WHEN n < 1 THEN 'no_pages' WHEN s < 1 OR s > n THEN 'start'
        WHEN m < 1 THEN 'max_pages' WHEN coalesce(e, n) < s OR coalesce(e, n) > n THEN 'end' END AS error FROM t)
    SELECT o_orderkey, CASE WHEN error IS NULL THEN least(w, s + m - 1) ELSE 0 END AS last,
      CASE WHEN error IS NULL AND least(w, s + m - 1) < w THEN least(w, s + m - 1) + 1 ELSE 0 END AS next, error FROM c""",
)
def _page_window(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(o_custkey % 40 AS int) AS n", "cast(o_orderkey % 23 AS int) AS s",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_orderkey % 37 AS int) END AS e",
        "cast(o_orderkey % 6 AS int) AS m",
    )
    window = pg.page_window(F.col("n"), F.col("s"), F.col("e"), F.col("m"))
    return rows.withColumn("w", window).select(
        "o_orderkey", F.coalesce("w.end", F.lit(0)).alias("last"),
        F.coalesce("w.next", F.lit(0)).alias("next"), "w.error",
    )


_SPEC_SQL = """CASE o_orderkey % 9 WHEN 0 THEN ' 2, 5-6,, 3 ' WHEN 1 THEN '1-' || (o_custkey % 12)
  WHEN 2 THEN 'x' WHEN 3 THEN '' WHEN 4 THEN '4-2' WHEN 5 THEN ',' WHEN 6 THEN '-3' WHEN 7 THEN '7,7,1-2'
  ELSE CAST(o_custkey % 15 AS VARCHAR) END"""


@REG.add(
    "parse_pages",
    f"""WITH t AS (SELECT o_orderkey, o_custkey, trim({_SPEC_SQL}) AS s FROM orders),
    parts AS (SELECT o_orderkey, i, trim(string_split(s, ',')[i]) AS p FROM t, unnest(range(1, len(string_split(s, ',')) + 1)) AS r(i)
      WHERE s <> '' AND trim(string_split(s, ',')[i]) <> ''),
    spans AS (SELECT o_orderkey, i, TRY_CAST(CASE WHEN contains(p, '-') THEN split_part(p, '-', 1) ELSE p END AS INTEGER) AS lo,
      TRY_CAST(CASE WHEN contains(p, '-') THEN substr(p, instr(p, '-') + 1) ELSE p END AS INTEGER) AS hi FROM parts),
    judged AS (SELECT *, CASE WHEN lo IS NULL OR hi IS NULL THEN 'format' WHEN lo > hi THEN 'order'
      WHEN lo < 1 OR hi > 10 THEN 'bounds' END AS e FROM spans),
    errs AS (SELECT o_orderkey, arg_min(e, i) FILTER (e IS NOT NULL) AS error, count(*) AS n FROM judged GROUP BY 1),
    pages AS (SELECT o_orderkey, string_agg(CAST(pg AS VARCHAR), ',' ORDER BY pg) AS listed FROM
      (SELECT DISTINCT o_orderkey, unnest(range(lo, hi + 1)) AS pg FROM judged WHERE e IS NULL) GROUP BY 1)
    SELECT t.o_orderkey, CASE WHEN s = '' THEN '1,2,3,4,5,6,7,8,9,10' WHEN n IS NULL OR error IS NOT NULL THEN '' ELSE listed END AS pages,
      CASE WHEN s = '' THEN NULL WHEN n IS NULL THEN 'empty' ELSE error END AS error
    FROM t LEFT JOIN errs USING (o_orderkey) LEFT JOIN pages USING (o_orderkey)""",
)
def _parse_pages(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{_SPEC_SQL.replace('VARCHAR', 'STRING')} AS s"
    )
    parsed = rows.withColumn("p", pg.parse_pages(F.col("s"), F.lit(10)))
    listed = F.array_join(F.col("p.pages").cast("array<string>"), ",")
    return parsed.select("o_orderkey", F.coalesce(listed, F.lit("")).alias("pages"), "p.error")


def doc_pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS doc_id", "cast(turn + 1 AS int) AS page"
    )


PAGES_SQL = """pages_ AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page FROM conversations),
counts AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM pages_ GROUP BY 1)"""


@REG.add(
    "reorder_pages",
    f"""WITH {PAGES_SQL} SELECT doc_id, page, CASE WHEN doc_id % 3 = 0 THEN n + 1 - page
      WHEN page = n THEN 1 ELSE page + 1 END AS position FROM pages_ JOIN counts USING (doc_id) WHERE doc_id % 3 < 2""",
)
def _reorder(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    orders = pages.groupBy("doc_id").agg(F.max("page").alias("n")).selectExpr(
        "doc_id",
        """CASE doc_id % 3 WHEN 0 THEN reverse(sequence(1, n))
           WHEN 1 THEN concat(array(n), filter(sequence(1, n), x -> x < n))
           ELSE array(1, 1) END AS `order`""",
    )
    return op.reorder(pages, orders)[0]


@REG.add(
    "drop_pages",
    f"""WITH {PAGES_SQL} SELECT doc_id, page, CAST(CASE WHEN doc_id % 4 <> 0 OR n < 3 OR page = 1 THEN page
      ELSE page - 1 END AS INTEGER) AS position FROM pages_ JOIN counts USING (doc_id)
    WHERE NOT (doc_id % 4 = 0 AND n >= 3 AND page = 2) AND NOT (doc_id % 4 = 0 AND n = 2 AND page = 2)""",
)
def _drop(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    drops = pages.groupBy("doc_id").agg(F.max("page").alias("n")).selectExpr(
        "doc_id", "CASE doc_id % 4 WHEN 0 THEN array(2) WHEN 1 THEN array(99) ELSE sequence(1, n) END AS positions"
    ).filter("doc_id % 4 < 3")
    return op.drop_positions(pages, drops)[0]


@REG.add(
    "merge_pages",
    f"""WITH {PAGES_SQL}, p AS (SELECT doc_id, n, doc_id % 5 AS output,
        coalesce(sum(n) OVER (PARTITION BY doc_id % 5 ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts)
    SELECT output, doc_id, page, CAST(before + page AS BIGINT) AS position FROM pages_ JOIN p USING (doc_id)""",
)
def _merge(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    plan = pages.select("doc_id").distinct().selectExpr(
        "doc_id % 5 AS output", "-doc_id AS ordinal", "doc_id"
    )
    return op.concat_pages(pages, plan).select("output", "doc_id", "page", "position")


@REG.add(
    "split_pages",
    f"""WITH {PAGES_SQL} SELECT doc_id, page, '1-2,4' AS label, 'pages_1-2_4' AS name FROM pages_ JOIN counts USING (doc_id)
      WHERE n >= 4 AND page IN (1, 2, 4) UNION ALL
    SELECT doc_id, page, CAST(n AS VARCHAR), 'pages_' || n FROM pages_ JOIN counts USING (doc_id) WHERE page = n""",
)
def _split(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    ranges = pages.groupBy("doc_id").agg(F.max("page").alias("n")).selectExpr(
        "doc_id", "explode(array('1-2,4', cast(n AS string))) AS label"
    )
    return op.split_pages(pages, ranges)[0].select("doc_id", "page", "label", "name")


@REG.add(
    "layout_histogram",
    """SELECT round_even(p_retailprice / 7, 2) AS width_points, round_even(p_size * 1.5::DOUBLE, 2) AS height_points,
      CAST(((p_partkey % 9 - 4) * 90 % 360 + 360) % 360 AS INTEGER) AS rotation, count(*) AS count FROM part GROUP BY ALL""",
)
def _layout(spark, sf_dir):
    return op.layout_histogram(
        fx.table(spark, sf_dir, "part").selectExpr(
            "p_retailprice / 7 AS width", "p_size * 1.5D AS height",
            "cast((p_partkey % 9 - 4) * 90 AS int) AS rotation",
        )
    )


@REG.add(
    "text_totals",
    f"""WITH {fx.PARAGRAPHS_SQL} SELECT doc_id, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS character_count,
      CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS word_count FROM paras GROUP BY 1""",
)
def _totals(spark, sf_dir):
    return op.text_totals(fx.paragraphs(spark, sf_dir))
