"""Text edit and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Registry
from parlance import fixtures as fx
from parlance.functions import pages as pg
from parlance.operators import schedules, textedit as op
from parlance.operators.ordered import running_total

REG = Registry()
QUERIES, ORACLE = REG.queries, REG.oracle


@REG.add(
    "replace_literal",
    f"""WITH {fx.PARAGRAPHS_SQL} SELECT doc_id, pos, replace(text, 'the.', '$1\\.') AS text,
      CAST((length(text) - length(replace(text, 'the.', ''))) // 4 AS INTEGER) AS replaced FROM paras""",
)
def _replace(spark, sf_dir):
    return op.replace_literal(fx.paragraphs(spark, sf_dir), "the.", "$1\\.")


# Words and separators alternate, so a whole-word match is one equal token.
_TOKENS_SQL = f"""{fx.PARAGRAPHS_SQL}, toks AS (SELECT doc_id, pos, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS t FROM paras),
counted AS (SELECT *, len(list_filter(t, lambda x: lower(x) = 'the')) AS n FROM toks)"""


@REG.add(
    "replace_whole_words",
    f"""WITH {_TOKENS_SQL} SELECT doc_id, pos, array_to_string(list_transform(t, lambda x: CASE WHEN lower(x) = 'the' THEN '<THE>' ELSE x END), '') AS text,
      CAST(n AS INTEGER) AS replaced FROM counted""",
)
def _whole(spark, sf_dir):
    return op.replace_literal(
        fx.paragraphs(spark, sf_dir), "the", "<THE>", match_case=False, whole_word=True
    )


_LIMIT_SQL = f"""{fx.PARAGRAPHS_SQL}, hits AS (SELECT doc_id, pos, text, CAST((length(text) - length(replace(text, 'th', ''))) // 2 AS INTEGER) AS n FROM paras),
prior AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hits),
cut AS (SELECT *, CAST(greatest(0, least(n, 7 - before)) AS INTEGER) AS take, string_split(text, 'th') AS parts FROM prior)"""


@REG.add(
    "replace_with_limit",
    f"""WITH {_LIMIT_SQL} SELECT doc_id, pos, CASE WHEN take = 0 THEN text ELSE
      array_to_string(parts[1:take], 'TH') || 'TH' || array_to_string(parts[take + 1:], 'th') END AS text, take AS replaced FROM cut""",
)
def _limited(spark, sf_dir):
    return op.replace_literal(fx.paragraphs(spark, sf_dir), "th", "TH", count=7)


@REG.add(
    "affected_paragraphs",
    f"""WITH {_LIMIT_SQL} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM cut WHERE take > 0 QUALIFY rank <= 3""",
)
def _affected(spark, sf_dir):
    replaced = op.replace_literal(fx.paragraphs(spark, sf_dir), "th", "TH", count=7)
    kept = op.affected_paragraphs(replaced, 3)[0]
    return kept.withColumn("rank", F.col("rank").cast("long"))


@REG.add(
    "remove_matching",
    f"""WITH {fx.PARAGRAPHS_SQL}, m AS (SELECT *, contains(text, 'er') AS hit FROM paras),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hit ORDER BY pos) AS nth FROM m)
    SELECT doc_id, pos, text FROM r WHERE NOT hit OR nth > 2""",
)
def _remove(spark, sf_dir):
    return op.remove_matching(fx.paragraphs(spark, sf_dir), "er", "contains", 2)


@REG.add(
    "label_matching",
    f"""WITH {fx.PARAGRAPHS_SQL} SELECT doc_id, pos, CASE WHEN contains(text, 'ing') THEN 'Heading 1' END AS style FROM paras""",
)
def _label(spark, sf_dir):
    rows = op.label_matching(fx.paragraphs(spark, sf_dir), "ing", "Heading 1")
    return rows.select("doc_id", "pos", "style")


@REG.add(
    "insert_after",
    f"""WITH {fx.PARAGRAPHS_SQL}, a AS (SELECT doc_id, min(pos) AS a FROM paras WHERE contains(text, 'and') GROUP BY 1)
    SELECT doc_id, CAST(CASE WHEN pos > a THEN pos + 2 ELSE pos END AS INTEGER) AS pos, text FROM paras LEFT JOIN a USING (doc_id)
    UNION ALL SELECT doc_id, CAST(a + 1 AS INTEGER), 'first' FROM a UNION ALL SELECT doc_id, CAST(a + 2 AS INTEGER), 'second' FROM a""",
)
def _insert(spark, sf_dir):
    return op.insert_after(fx.paragraphs(spark, sf_dir), "and", ["first", "second"])


@REG.add(
    "running_total",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_returnflag
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM lineitem""",
)
def _running(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = running_total(
        fx.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", *keys),
        ["l_returnflag"], keys, F.expr("l_orderkey DIV 256"),
        F.col("l_quantity").cast("long"), out="total",
    )
    return out.select(*keys, "total")


_DAYS_SQL = """CASE o_orderkey % 10 WHEN 0 THEN '[1, 3, "5", 3]' WHEN 1 THEN ' 7, 2 ,,1 ' WHEN 2 THEN '0,1' WHEN 3 THEN '' WHEN 4 THEN '[true]'
  WHEN 5 THEN 'x' WHEN 6 THEN '[' WHEN 7 THEN '[8]' WHEN 8 THEN '[]' ELSE CAST(1 + o_custkey % 7 AS VARCHAR) END"""


@REG.add(
    "parse_weekdays",
    """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '1,3,5' WHEN 1 THEN '1,2,7' WHEN 9 THEN CAST(1 + o_custkey % 7 AS VARCHAR) ELSE '' END AS days,
      CASE o_orderkey % 10 WHEN 2 THEN 'bounds' WHEN 3 THEN 'empty' WHEN 4 THEN 'type' WHEN 5 THEN 'type' WHEN 6 THEN 'format' WHEN 7 THEN 'bounds'
        WHEN 8 THEN 'empty' END AS error FROM orders""",
)
def _weekdays(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{_DAYS_SQL.replace('VARCHAR', 'STRING')} AS d"
    )
    parsed = rows.withColumn("p", pg.parse_weekdays(F.col("d")))
    days = F.array_join(F.col("p.days").cast("array<string>"), ",")
    return parsed.select("o_orderkey", F.coalesce(days, F.lit("")).alias("days"), "p.error")


_NOW = 1704067200
_SPEC = (
    "CASE o_orderkey % 13 WHEN 0 THEN ' ' ELSE 'task' END AS name",
    "CASE o_orderkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'delay_once' WHEN 3 THEN 'cn_workday' ELSE 'delay_once' END AS schedule_type",
    "CASE WHEN o_orderkey % 5 IN (2, 4) THEN '' WHEN o_orderkey % 17 = 1 THEN '24:00' ELSE '08:30' END AS time",
    "CASE WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '1,5' END WHEN o_orderkey % 35 = 3 THEN '2' ELSE '' END AS weekdays",
    "CASE WHEN o_orderkey % 5 = 2 THEN CAST(o_custkey * 60 AS INT) END AS delay_seconds",
    "CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 5 END AS delay_minutes",
    "CASE WHEN o_orderkey % 45 = 4 THEN 24 WHEN o_orderkey % 45 = 9 THEN 25 END AS delay_hours",
    "CASE WHEN o_orderkey % 45 = 14 THEN '2024-01-01 08:00:01' WHEN o_orderkey % 45 = 19 THEN 'soon' END AS run_at",
    "CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 = 1 THEN repeat('x', 501) ELSE 'hello' END AS content",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'ask' ELSE ' ' END AS ai_prompt",
)


@REG.add(
    "validate_schedule",
    f"""WITH s AS (SELECT o_orderkey, {', '.join(_SPEC)} FROM orders), d AS (SELECT *, coalesce(delay_seconds, delay_minutes * 60, delay_hours * 3600,
        CASE WHEN run_at LIKE '2024%' THEN 1 END) AS delay, (delay_seconds IS NOT NULL)::INT + (delay_minutes IS NOT NULL)::INT + (delay_hours IS NOT NULL)::INT + (run_at IS NOT NULL)::INT AS given FROM s)
    SELECT o_orderkey, CASE WHEN given > 1 THEN 'several_delays' WHEN trim(name) = '' THEN 'name_blank' WHEN length(content) > 500 THEN 'content_long'
      WHEN content = '' AND trim(ai_prompt) = '' THEN 'no_text' WHEN schedule_type = 'delay_once' THEN
        CASE WHEN given = 0 THEN 'no_delay' WHEN delay IS NULL THEN 'run_at_format' WHEN delay < 1 OR delay > 86400 THEN 'delay_bounds' END
      WHEN given > 0 THEN 'delay_not_allowed' WHEN time = '24:00' THEN 'clock' WHEN schedule_type = 'weekly' AND weekdays = '0' THEN 'weekdays_bounds'
      WHEN schedule_type <> 'weekly' AND weekdays <> '' THEN 'weekdays_not_allowed' END AS error FROM d""",
)
def _schedule(spark, sf_dir):
    specs = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_SPEC)
    return schedules.validate_schedule(specs, F.lit(_NOW)).select("o_orderkey", "error")
