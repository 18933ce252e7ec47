"""Document package queries: real zip packages built by Spark, and audit joins on big tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Registry
from parlance import fixtures as fx
from parlance.functions.boxes import out_of_bounds
from parlance.functions.text import has_placeholder
from parlance.operators import packages as op
from parlance.operators.ordered import missing_names
from parlance.sources import packages as src

REG = Registry()
QUERIES, ORACLE = REG.queries, REG.oracle

_P = "'p' || doc_id || '.docx'"


@REG.add(
    "package_members",
    f"""WITH d AS (SELECT {_P} AS path, doc_id AS k FROM documents)
    SELECT path, name FROM d, (VALUES ('[Content_Types].xml'), ('word/document.xml'), ('word/comments.xml')) AS n(name)
    UNION ALL SELECT path, '_rels/.rels' FROM d WHERE k % 5 <> 0
    UNION ALL SELECT path, 'word/media/image1.png' FROM d WHERE k % 3 = 0
    UNION ALL SELECT path, '../evil.xml' FROM d WHERE k % 13 = 0""",
)
def _members(spark, sf_dir):
    return src.package_members(fx.package_files(spark, sf_dir)).select("path", "name")


@REG.add(
    "package_profile",
    f"""SELECT {_P} AS path, 3 + (doc_id % 5 <> 0)::BIGINT + (doc_id % 3 = 0)::BIGINT + (doc_id % 13 = 0)::BIGINT AS member_count,
      3 + (doc_id % 5 <> 0)::BIGINT + (doc_id % 13 = 0)::BIGINT AS xml_part_count, (doc_id % 3 = 0)::BIGINT AS media_count,
      CASE WHEN doc_id % 5 = 0 THEN '_rels/.rels' ELSE '' END AS missing, CASE WHEN doc_id % 13 = 0 THEN 'unsafe_name' END AS error
    FROM documents""",
)
def _profile(spark, sf_dir):
    rows = op.package_profile(src.package_members(fx.package_files(spark, sf_dir)))
    return rows.select(
        "path", "member_count", "xml_part_count", "media_count",
        F.array_join("missing_required_parts", ",").alias("missing"), "error",
    )


@REG.add(
    "unsafe_members",
    f"SELECT {_P} AS path, '../evil.xml' AS name FROM documents WHERE doc_id % 13 = 0",
)
def _unsafe(spark, sf_dir):
    members = src.package_members(fx.package_files(spark, sf_dir))
    return members.filter(src.unsafe_member(F.col("name"))).select("path", "name")


_ISSUES_SQL = f"""issues AS (
  SELECT {_P} AS path, 'missing_content_type_part' AS code, '[Content_Types].xml' AS part, 'word/gone' || doc_id || '.xml' AS message FROM documents
  UNION ALL SELECT {_P}, 'duplicate_content_type_override', '[Content_Types].xml', 'word/document.xml' FROM documents WHERE doc_id % 6 = 0
  UNION ALL SELECT {_P}, 'duplicate_relationship_id', '_rels/.rels', 'r1' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 4 = 0
  UNION ALL SELECT {_P}, 'missing_relationship_target', '_rels/.rels', 'word/lost.xml' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 4 = 0
  UNION ALL SELECT {_P}, 'unsafe_relationship_target', '_rels/.rels', '../out.xml' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 11 = 0
  UNION ALL SELECT {_P}, 'xml_parse_error', '../evil.xml', '../evil.xml' FROM documents WHERE doc_id % 13 = 0)"""


def _issues(spark, sf_dir):
    files = fx.package_files(spark, sf_dir)
    return op.edge_issues(src.package_edges(files), src.package_members(files))


@REG.add("package_issues", f"WITH {_ISSUES_SQL} SELECT * FROM issues")
def _edge_issues(spark, sf_dir):
    return _issues(spark, sf_dir).drop("slide")


@REG.add(
    "issue_rollup",
    f"""WITH {_ISSUES_SQL} SELECT path, 'invalid' AS status, count(*) AS issue_count, greatest(0, count(*) - 2) AS issues_truncated
    FROM issues GROUP BY 1""",
)
def _rollup(spark, sf_dir):
    return op.issue_rollup(_issues(spark, sf_dir), fx.package_files(spark, sf_dir), 2)[1]


@REG.add(
    "dangling_edges",
    f"""WITH {_ISSUES_SQL} SELECT path, message AS resolved FROM issues WHERE code LIKE 'missing_%'""",
)
def _dangling(spark, sf_dir):
    files = fx.package_files(spark, sf_dir)
    rows = op.dangling_edges(src.package_edges(files), src.package_members(files))
    return rows.select("path", "resolved")


@REG.add(
    "revision_summary",
    f"""SELECT {_P} AS path, n % 6 // 2 AS insertions, (n % 6 + 1) // 2 AS deletions, 0::BIGINT AS moves_from, 0::BIGINT AS moves_to,
      0::BIGINT AS property_changes, n % 6 AS total, (n % 6 + 1) // 2 AS missing_author_count, (n % 6 + 1) // 2 AS missing_date_count
    FROM (SELECT doc_id, n_chars AS n FROM documents) WHERE n % 6 > 0""",
)
def _revisions(spark, sf_dir):
    return op.revision_summary(src.package_elements(fx.package_files(spark, sf_dir)))


@REG.add(
    "revision_authors",
    f"""SELECT DISTINCT {_P} AS path, 'a' || (i % 3) AS author FROM documents, range(6) AS r(i) WHERE i < n_chars % 6 AND i % 2 = 1""",
)
def _authors(spark, sf_dir):
    return op.revision_authors(src.package_elements(fx.package_files(spark, sf_dir)))


@REG.add(
    "comment_balance",
    f"""WITH c AS (SELECT {_P} AS path, doc_id AS k, i FROM documents, range(9) AS r(i) WHERE i < doc_id % 9)
    SELECT path, CAST(i AS VARCHAR) AS id, 'undefined_comment_reference' AS code FROM c WHERE i >= k % 4
    UNION ALL SELECT path, CAST(i AS VARCHAR), 'unbalanced_comment_range' FROM c WHERE i % 5 = 0
    UNION ALL SELECT path, CAST(i AS VARCHAR), 'missing_comment_reference' FROM c WHERE i % 7 = 0""",
)
def _comments(spark, sf_dir):
    return op.comment_balance(src.package_elements(fx.package_files(spark, sf_dir)))


@REG.add(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n, 'duplicate' AS problem FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _duplicates(spark, sf_dir):
    return op.duplicate_keys(fx.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@REG.add(
    "undefined_refs",
    """SELECT DISTINCT o_custkey + 40 AS id FROM orders WHERE o_custkey + 40 NOT IN (SELECT c_custkey FROM customer)""",
)
def _undefined(spark, sf_dir):
    refs = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey + 40 AS id")
    defs = fx.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id")
    return op.undefined_refs(refs, defs, ["id"])


@REG.add(
    "missing_names",
    """SELECT l_partkey AS part, CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE 'x' END AS tag, count(*) AS n FROM lineitem
    WHERE l_partkey % 10 <> 0 OR l_suppkey % 2 = 1 GROUP BY 1, 2""",
)
def _missing(spark, sf_dir):
    required = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS part", "CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE 'x' END AS tag"
    )
    present = fx.table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").selectExpr(
        "p_partkey AS part", "cast(NULL AS string) AS tag"
    )
    lost = missing_names(required, present, ["part", "tag"])
    return lost.groupBy("part", "tag").agg(F.count("*").alias("n"))


_ISSUE_COLUMNS = (
    "concat('book', o_custkey % 20) AS path",
    "CASE o_orderkey % 4 WHEN 0 THEN 'invalid_xml' WHEN 1 THEN 'shape_out_of_bounds' ELSE 'no_slides' END AS code",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS part",
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_orderkey % 50 AS int) END AS slide",
    "o_orderpriority AS message",
)


@REG.add(
    "new_issues",
    f"""WITH i AS (SELECT {', '.join(_ISSUE_COLUMNS)}, o_orderkey FROM orders), b AS (SELECT * FROM i WHERE o_orderkey % 2 = 0)
    SELECT path, code, part, slide, message, count(*) AS n FROM i WHERE NOT EXISTS (SELECT 1 FROM b
      WHERE b.code IN ('invalid_xml', 'shape_out_of_bounds') AND b.path = i.path AND b.code = i.code
        AND b.part IS NOT DISTINCT FROM i.part AND b.slide IS NOT DISTINCT FROM i.slide AND b.message = i.message) GROUP BY ALL""",
)
def _new_issues(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    current = orders.selectExpr(*_ISSUE_COLUMNS)
    baseline = orders.filter("o_orderkey % 2 = 0").selectExpr(*_ISSUE_COLUMNS)
    fresh = op.new_issues(current, baseline)
    return fresh.groupBy(*current.columns).agg(F.count("*").alias("n"))


@REG.add(
    "undeclared_axes",
    """WITH a AS (SELECT o_custkey AS chart, o_orderkey % 40 AS val FROM orders WHERE o_orderkey % 3 > 0),
    d AS (SELECT o_custkey AS chart, o_orderkey % 40 AS val FROM orders WHERE o_orderkey % 3 = 0)
    SELECT DISTINCT chart, val FROM (SELECT * FROM a UNION ALL SELECT * FROM d) u WHERE chart IN (SELECT chart FROM d)
      AND NOT EXISTS (SELECT 1 FROM d WHERE d.chart = u.chart AND d.val = u.val)""",
)
def _axes(spark, sf_dir):
    elements = fx.table(spark, sf_dir, "orders").selectExpr(
        "'deck' AS path", "cast(o_custkey AS string) AS part", "'axId' AS tag",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'valAx' ELSE 'barChart' END AS parent",
        "cast(o_orderkey % 40 AS string) AS val",
    )
    rows = op.undeclared_axes(elements)
    return rows.selectExpr("cast(part AS bigint) AS chart", "cast(val AS bigint) AS val")


@REG.add(
    "shapes_out_of_bounds",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey * 10 - 5000 < -2000 OR l_suppkey * 100 - 3000 < -2000
      OR l_partkey * 10 - 5000 + l_quantity * 100 > 10000 + 2000 OR l_suppkey * 100 - 3000 + l_linenumber * 50 > 5000 + 2000""",
)
def _bounds(spark, sf_dir):
    outside = out_of_bounds(
        F.expr("l_partkey * 10 - 5000"), F.expr("l_suppkey * 100 - 3000"), F.expr("l_quantity * 100"),
        F.expr("l_linenumber * 50"), F.lit(10000), F.lit(5000),
    )
    rows = fx.table(spark, sf_dir, "lineitem").filter(outside)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_SLIDE_SQL = """CASE doc_id % 6 WHEN 0 THEN text || ' Lorem' WHEN 1 THEN 'xxxx ' || text WHEN 2 THEN '[Insert here] ' || text
  WHEN 3 THEN 'This  page uses a layout' WHEN 4 THEN text || 'todoist' ELSE text END"""


@REG.add(
    "placeholder_text",
    f"""SELECT doc_id FROM (SELECT doc_id, {_SLIDE_SQL} AS t FROM documents)
    WHERE regexp_matches(t, '(?i)\\b(?:lorem|ipsum|todo|x{{3,}})\\b|\\[insert|this\\s+(?:page|slide).+layout')""",
)
def _placeholder(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SLIDE_SQL} AS t")
    return rows.filter(has_placeholder(F.col("t"))).select("doc_id")


@REG.add(
    "workbook_format",
    """SELECT 'f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.xls' WHEN 1 THEN '.xlsx' ELSE '.xlsm' END AS path,
      CASE doc_id % 6 WHEN 0 THEN '.xls' WHEN 3 THEN NULL ELSE CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '.xlsx' END END AS detected,
      CASE doc_id % 6 WHEN 0 THEN NULL WHEN 3 THEN 'not_legacy' ELSE CASE WHEN doc_id % 7 = 0 THEN 'not_workbook'
        WHEN doc_id % 3 = 2 THEN 'suffix_mismatch' END END AS error FROM documents""",
)
def _format(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    path = "concat('f', doc_id, CASE doc_id % 3 WHEN 0 THEN '.xls' WHEN 1 THEN '.xlsx' ELSE '.xlsm' END) AS path"
    files = docs.selectExpr(
        path,
        "CASE WHEN doc_id % 6 = 0 THEN concat(X'D0CF11E0A1B11AE1', encode(text, 'UTF-8')) ELSE encode(text, 'UTF-8') END AS content",
    )
    edges = docs.filter("doc_id % 7 <> 0").selectExpr(
        path, "'override' AS kind", "'/xl/workbook.xml' AS target", "0 AS seq",
        "'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml' AS type",
    )
    return src.format_error(files, edges)
