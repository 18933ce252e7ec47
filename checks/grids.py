"""Cell grid and delimited file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Registry
from parlance import fixtures as fx
from parlance.functions import cells as fc
from parlance.operators import edits, rectangles
from parlance.operators import grids as op
from parlance.operators.ordered import cap_per_group
from parlance.sources import delimited

REG = Registry()
QUERIES, ORACLE = REG.queries, REG.oracle

CODES = "('#NULL!', '#DIV/0!', '#VALUE!', '#REF!', '#NAME?', '#NUM!', '#N/A')"


def _error(col):
    return f"CASE WHEN upper(trim({col})) IN {CODES} THEN upper(trim({col})) END"


_LETTERS = "['A', 'B', 'C', 'D', 'E'][col]"
_FAILED_SQL = f"""{fx.CELLS_SQL}, failed AS (SELECT *, {_error('cached_value')} AS error FROM cells WHERE formula IS NOT NULL)"""


@REG.add(
    "sheet_profile",
    f"""WITH {fx.CELLS_SQL} SELECT path, sheet, max(row) AS max_row, max(col) AS max_column,
      count(*) FILTER (formula IS NOT NULL) AS formula_count,
      count(*) FILTER ({_error('value')} IS NOT NULL) AS literal_error_count FROM cells GROUP BY 1, 2""",
)
def _sheet_profile(spark, sf_dir):
    return op.sheet_profile(fx.cells(spark, sf_dir))


@REG.add(
    "error_locations",
    f"""WITH {_FAILED_SQL} SELECT path, error, sheet, {_LETTERS} || row AS cell, formula,
      row_number() OVER (PARTITION BY path, error ORDER BY sheet, row, col) AS rank FROM failed
    WHERE error IS NOT NULL QUALIFY rank <= 100""",
)
def _error_locations(spark, sf_dir):
    rows = op.error_locations(fx.cells(spark, sf_dir))[0]
    return rows.select("path", "error", "sheet", "cell", "formula", F.col("rank").cast("long").alias("rank"))


@REG.add(
    "error_counts",
    f"""WITH {_FAILED_SQL} SELECT path, error, count(*) AS total, greatest(0, count(*) - 100) AS truncated
    FROM failed WHERE error IS NOT NULL GROUP BY 1, 2""",
)
def _error_counts(spark, sf_dir):
    return op.error_locations(fx.cells(spark, sf_dir))[1]


@REG.add(
    "error_summary",
    f"""WITH {_FAILED_SQL} SELECT path, count(*) AS total_formulas, count(error) AS total_errors,
      count(*) FILTER (cached_value IS NULL) AS missing_cached_value_count,
      CASE WHEN count(error) = 0 THEN 'success' ELSE 'errors_found' END AS status FROM failed GROUP BY 1""",
)
def _error_summary(spark, sf_dir):
    return op.error_summary(fx.cells(spark, sf_dir))


@REG.add(
    "risky_formulas",
    f"""WITH {fx.CELLS_SQL} SELECT path, sheet, row, col, {_LETTERS} || row AS cell, formula,
      row_number() OVER (PARTITION BY path ORDER BY sheet, row, col) AS rank
    FROM cells WHERE regexp_matches(formula, '(?i)\\b(XLOOKUP|XMATCH|SORT|FILTER|UNIQUE|SEQUENCE)\\s*\\(') QUALIFY rank <= 100""",
)
def _risky(spark, sf_dir):
    rows = op.risky_formulas(fx.cells(spark, sf_dir))[0]
    return rows.withColumn("rank", F.col("rank").cast("long"))


@REG.add(
    "cap_per_group",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey,
      row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank,
      count(*) OVER (PARTITION BY l_returnflag) - 200 AS truncated FROM lineitem QUALIFY rank <= 200""",
)
def _cap(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = fx.table(spark, sf_dir, "lineitem").select("l_returnflag", *keys)
    kept, totals = cap_per_group(rows, ["l_returnflag"], keys, 200)
    out = kept.join(totals, "l_returnflag").drop("total")
    return out.withColumn("rank", F.col("rank").cast("long"))


@REG.add(
    "grid_viewport",
    f"""WITH {fx.CELLS_SQL} SELECT path, sheet, row, col, value, formula, cached_value,
      {_error("CASE WHEN formula IS NOT NULL THEN cached_value ELSE value END")} AS error
    FROM cells WHERE row BETWEEN 50 AND 249 AND col BETWEEN 2 AND 5 AND (value IS NOT NULL OR formula IS NOT NULL OR cached_value IS NOT NULL)""",
)
def _viewport(spark, sf_dir):
    return op.grid_viewport(fx.cells(spark, sf_dir), 50, 2, 200, 100)[0]


@REG.add(
    "grid_viewport_cursor",
    f"""WITH {fx.CELLS_SQL}, e AS (SELECT path, sheet, max(row) AS r, max(col) AS c FROM cells GROUP BY 1, 2)
    SELECT path, sheet, least(r, 249) AS end_row, least(c, 3) AS end_column,
      CASE WHEN r > 249 THEN 250 ELSE 0 END AS next_row, CASE WHEN c > 3 THEN 4 ELSE 0 END AS next_column FROM e""",
)
def _viewport_cursor(spark, sf_dir):
    cursor = op.grid_viewport(fx.cells(spark, sf_dir), 50, 2, 200, 2)[1]
    return cursor.na.fill(0, ["next_row", "next_column"])


# Patches from lineitem: several writes may hit one cell, some are invalid, some new.
_PATCH = (
    "concat('book', o_custkey % 20) AS path", "o_orderstatus AS sheet",
    "cast(l_orderkey + 1 AS int) AS row", "cast(1 + l_linenumber % 6 AS int) AS col",
    "CASE WHEN l_linenumber % 3 < 2 THEN cast(l_partkey AS {text}) END AS value",
    "CASE WHEN l_linenumber % 3 = 2 THEN concat('=B', l_suppkey) WHEN l_linenumber % 7 = 0 THEN 'x' END AS formula",
    "l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS seq",
)
_PATCH_SQL = f"""{fx.CELLS_SQL}, patch AS (SELECT {', '.join(p.format(text='VARCHAR') for p in _PATCH)}
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
last AS (SELECT * FROM patch WHERE NOT (value IS NOT NULL AND formula IS NOT NULL) AND (formula IS NULL OR formula LIKE '=%')
  QUALIFY row_number() OVER (PARTITION BY path, sheet, row, col ORDER BY seq DESC) = 1)"""


def patch(spark, sf_dir):
    lines, orders = fx.table(spark, sf_dir, "lineitem"), fx.table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.selectExpr(*[p.format(text="STRING") for p in _PATCH])


@REG.add(
    "upsert_cells",
    f"""WITH {_PATCH_SQL} SELECT * FROM cells c WHERE NOT EXISTS
      (SELECT 1 FROM last l WHERE l.path = c.path AND l.sheet = c.sheet AND l.row = c.row AND l.col = c.col)
    UNION ALL SELECT path, sheet, row, col, value, formula, NULL FROM last""",
)
def _upsert(spark, sf_dir):
    return op.upsert_cells(fx.cells(spark, sf_dir), patch(spark, sf_dir))


@REG.add(
    "patch_errors",
    f"""WITH {_PATCH_SQL} SELECT path, sheet, row, col, seq, CASE WHEN value IS NOT NULL THEN 'value_and_formula'
      ELSE 'formula_without_equals' END AS error FROM patch WHERE (value IS NOT NULL AND formula IS NOT NULL) OR formula NOT LIKE '=%'""",
)
def _patch_errors(spark, sf_dir):
    return op.patch_errors(patch(spark, sf_dir)).drop("value", "formula")


@REG.add(
    "write_rows",
    """SELECT 'book' || (c_custkey % 20) AS path, 'F' AS sheet, CAST(2 + c_custkey AS INTEGER) AS row,
      CAST(2 + i AS INTEGER) AS col, CASE i WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS value,
      CASE i WHEN 2 THEN '=B' || c_custkey END AS formula, c_custkey AS seq FROM customer, range(3) AS r(i)""",
)
def _write_rows(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").selectExpr(
        "concat('book', c_custkey % 20) AS path", "'F' AS sheet", "' b2' AS start_cell",
        "cast(c_custkey AS int) AS offset",
        "array(c_name, c_mktsegment, concat('=B', c_custkey)) AS values", "c_custkey AS seq",
    )
    return op.rows_to_cells(rows)


@REG.add(
    "append_rows",
    f"""WITH {fx.CELLS_SQL}, m AS (SELECT path, sheet, max(row) AS r FROM cells GROUP BY 1, 2),
    added AS (SELECT 'book' || (s_suppkey % 20) AS path, 'O' AS sheet, s_suppkey + 1 AS idx, s_name, s_suppkey FROM supplier)
    SELECT * FROM cells UNION ALL
    SELECT a.path, a.sheet, CAST(coalesce(r, 0) + idx AS INTEGER), CAST(c AS INTEGER), CASE WHEN c = 1 THEN s_name END,
      CASE WHEN c = 3 THEN '=' || s_suppkey END, NULL
    FROM added a LEFT JOIN m ON m.path = a.path AND m.sheet = a.sheet, (VALUES (1), (3)) AS x(c)""",
)
def _append(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "supplier").selectExpr(
        "concat('book', s_suppkey % 20) AS path", "'O' AS sheet", "s_suppkey + 1 AS idx",
        "array(s_name, NULL, concat('=', s_suppkey)) AS values",
    )
    return op.append_rows(fx.cells(spark, sf_dir), rows)


@REG.add(
    "clear_range",
    f"""WITH {fx.CELLS_SQL} SELECT path, sheet, row, col, CASE WHEN NOT hit THEN value END AS value,
      CASE WHEN NOT hit THEN formula END AS formula, CASE WHEN NOT hit THEN cached_value END AS cached_value
    FROM (SELECT *, row BETWEEN 10 AND 5000 AND col BETWEEN 2 AND 5 AS hit FROM cells)""",
)
def _clear(spark, sf_dir):
    return op.clear_range(fx.cells(spark, sf_dir), "$b$10:E5000")


@REG.add(
    "insert_and_delete",
    f"""WITH {fx.CELLS_SQL}, i AS (SELECT * REPLACE (CASE WHEN row >= 100 THEN row + 7 ELSE row END AS row) FROM cells)
    SELECT * REPLACE (CASE WHEN col >= 4 THEN col - 2 ELSE col END AS col) FROM i WHERE col NOT BETWEEN 2 AND 3""",
)
def _shift(spark, sf_dir):
    grown = op.shift_rows(fx.cells(spark, sf_dir), 100, 7)
    return op.shift_rows(grown, 2, 2, axis="col", delete=True)


_VALUE_SQL = """CASE l_orderkey % 16 WHEN 0 THEN '00' || l_partkey WHEN 1 THEN ' ' || l_partkey || ' ' WHEN 2 THEN '-01'
  WHEN 3 THEN '1.50' WHEN 4 THEN 'TRUE' WHEN 5 THEN '  ' WHEN 6 THEN '1e3' WHEN 7 THEN 'nan' WHEN 8 THEN '0'
  WHEN 9 THEN '-0' WHEN 10 THEN 'false ' WHEN 11 THEN '12 3' WHEN 12 THEN '+5' WHEN 13 THEN '99999999999999999999'
  WHEN 14 THEN '.5' ELSE l_returnflag || ' ' END"""


@REG.add(
    "coerce_cells",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_VALUE_SQL} AS v FROM lineitem),
    k AS (SELECT *, trim(v) AS s, lower(trim(v)) AS w FROM t),
    j AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN w IN ('true', 'false') THEN 'bool'
      WHEN regexp_matches(s, '^[+-]?\\d+$') AND NOT ((starts_with(s, '0') AND length(s) > 1) OR (starts_with(s, '-0') AND length(s) > 2))
        THEN CASE WHEN TRY_CAST(s AS BIGINT) IS NULL THEN 'bigint' ELSE 'int' END
      WHEN w = 'nan' OR regexp_matches(s, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN 'float' ELSE 'text' END AS kind FROM k)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, CASE kind WHEN 'bool' THEN w WHEN 'int' THEN CAST(CAST(s AS BIGINT) AS VARCHAR)
      WHEN 'bigint' THEN s WHEN 'text' THEN v WHEN 'blank' THEN '' ELSE '' END AS shown,
      CASE WHEN kind = 'float' AND w <> 'nan' THEN CAST(s AS DOUBLE) ELSE 0.0::DOUBLE END AS d FROM j""",
)
def _coerce(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr(*keys, f"{_VALUE_SQL} AS v")
    typed = rows.withColumn("c", fc.coerce_cell(F.col("v")))
    shown = F.coalesce(
        F.col("c.b").cast("string"), F.col("c.i").cast("string"), F.col("c.s"), F.lit("")
    )
    number = F.coalesce(F.nanvl(F.col("c.d"), F.lit(0.0)), F.lit(0.0))
    return typed.select(*keys, "c.kind", shown.alias("shown"), number.alias("d"))


_REF_SQL = """CASE p_partkey % 8 WHEN 0 THEN ' a' || (p_partkey + 1) WHEN 1 THEN 'XFD1048576' WHEN 2 THEN 'AB' || p_size
  WHEN 3 THEN 'A0' WHEN 4 THEN 'ABCD1' WHEN 5 THEN '$C$' || (p_size + 1) WHEN 6 THEN 'B2:aa' || (p_size + 1) ELSE p_name END"""


@REG.add(
    "parse_a1",
    f"""WITH t AS (SELECT p_partkey, upper(trim({_REF_SQL})) AS s, upper(trim(replace({_REF_SQL}, '$', ''))) AS z FROM part),
    m AS (SELECT *, regexp_extract(s, '^([A-Z]{{1,3}})([1-9][0-9]{{0,6}})$', ['l', 'n']) AS x,
      regexp_extract(z, '^([A-Z]{{1,3}})([1-9][0-9]{{0,6}})(:([A-Z]{{1,3}})([1-9][0-9]{{0,6}}))?$', ['l', 'n', 'p', 'l2', 'n2']) AS y FROM t)
    SELECT p_partkey, CASE WHEN x.l <> '' THEN x.l || '/' || x.n ELSE '' END AS cell,
      CASE WHEN y.l <> '' THEN y.l || y.n || '-' || CASE WHEN y.p = '' THEN y.l || y.n ELSE y.l2 || y.n2 END ELSE '' END AS span FROM m""",
)
def _a1(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_REF_SQL} AS s")
    rows = rows.withColumn("x", fc.parse_a1(F.col("s"))).withColumn("y", fc.parse_range(F.col("s")))
    cell = F.concat(fc.column_letters(F.col("x.col")), F.lit("/"), F.col("x.row"))
    span = F.concat(
        fc.a1(F.col("y.row"), F.col("y.col")), F.lit("-"), fc.a1(F.col("y.end_row"), F.col("y.end_col"))
    )
    return rows.select(
        "p_partkey", F.coalesce(cell, F.lit("")).alias("cell"), F.coalesce(span, F.lit("")).alias("span")
    )


_RULES = (
    {"name": "status", "column": "o_orderstatus", "kind": "list", "values": ["O", "F"]},
    {"name": "price", "column": "o_totalprice", "kind": "decimal", "low": 1000.0, "high": 400000.0},
    {"name": "customer", "column": "o_custkey", "kind": "whole", "operator": "greaterThanOrEqual", "low": 10},
    {"name": "priority", "column": "o_orderpriority", "kind": "textLength", "operator": "lessThan", "low": 8},
)


@REG.add(
    "check_rules",
    """SELECT o_orderkey, 'status' AS rule, 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT o_orderkey, 'customer', 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey < 10
    UNION ALL SELECT o_orderkey, 'priority', 'o_orderpriority', o_orderpriority FROM orders WHERE length(o_orderpriority) >= 8
    UNION ALL SELECT o_orderkey, 'price', 'o_totalprice', '' FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000""",
)
def _rules(spark, sf_dir):
    found = op.check_rules(fx.table(spark, sf_dir, "orders"), ["o_orderkey"], _RULES)
    value = F.when(F.col("rule") == "price", "").otherwise(F.col("value"))
    return found.withColumn("value", value)


@REG.add(
    "scale_position",
    """WITH s AS (SELECT l_returnflag, min(l_extendedprice) AS lo, quantile_cont(l_extendedprice, 0.5) AS mid, max(l_extendedprice) AS hi
      FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mid, 4) AS median, round(CASE WHEN l_extendedprice <= mid
      THEN (l_extendedprice - lo) / (mid - lo) * 0.5 ELSE 0.5 + (l_extendedprice - mid) / (hi - mid) * 0.5 END, 6) AS position,
      l_extendedprice > 50000 AS flagged
    FROM lineitem JOIN s USING (l_returnflag)""",
)
def _scale(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem")
    out = op.scale_position(rows, ["l_returnflag"], "l_extendedprice")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round("percentile", 4).alias("median"), F.round("position", 6).alias("position"),
        op.cell_flag(F.col("l_extendedprice"), "greaterThan", 50000.0).alias("flagged"),
    )


# A document as a file: trimmed of newlines, without quotes, blanks as separators.
_LINES_SQL = """body AS (SELECT 'doc' || doc_id || '.csv' AS path, string_split(replace(replace(trim(text, chr(10)), '"', ''), ',', ''), chr(10)) AS lines
  FROM documents WHERE trim(text, chr(10)) <> ''),
rows_ AS (SELECT path, i AS row, lines[i] AS line FROM body, unnest(range(1, len(lines) + 1)) AS r(i))"""


@REG.add(
    "delimited_cells",
    f"""WITH {_LINES_SQL} SELECT path, row, replace(line, ' ', '|') AS joined,
      CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END AS n FROM rows_""",
)
def _delimited(spark, sf_dir):
    rows = delimited.delimited_cells(fx.delimited_files(spark, sf_dir))
    return rows.select(
        "path", "row", F.array_join("cells", "|").alias("joined"),
        F.size("cells").cast("long").alias("n"),
    )


@REG.add(
    "delimited_profile",
    f"""WITH {_LINES_SQL} SELECT path, count(*) AS row_count,
      CAST(max(CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END) AS INTEGER) AS max_column_count FROM rows_ GROUP BY 1""",
)
def _delimited_profile(spark, sf_dir):
    return op.delimited_profile(delimited.delimited_cells(fx.delimited_files(spark, sf_dir)))


_SNIFF_SQL = """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(10) || ' ' WHEN 2 THEN ' <HTML>' || left(text, 50)
  WHEN 3 THEN text ELSE 'a' || chr(9) || text END"""


@REG.add(
    "sniff_delimited",
    """SELECT doc_id, CASE WHEN doc_id % 5 >= 3 THEN 'utf-8-sig' END AS encoding, CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'blank'
      WHEN 2 THEN 'markup' END AS error FROM documents""",
)
def _sniff(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"encode({_SNIFF_SQL.replace('||', ' || ')}, 'UTF-8') AS content"
    )
    sniffed = rows.withColumn("s", delimited.sniff_delimited(F.col("content")))
    return sniffed.select("doc_id", "s.encoding", "s.error")


# A log from `events`: several hundred edits a sheet at the smallest scale, of some sheets that have no cells yet.
_LOG = (
    "concat('book', event_id % 4) AS path", "substr('OFN', 1 + cast(user_id % 3 AS int), 1) AS sheet", "event_id AS seq",
    """CASE WHEN event_id % 8 = 0 THEN 'insert_rows' WHEN event_id % 8 = 1 THEN 'delete_rows' WHEN event_id % 50 = 2 THEN 'insert_columns'
      WHEN event_id % 75 = 3 THEN 'delete_columns' WHEN event_id % 8 = 4 THEN 'clear' ELSE 'write' END AS op""",
    "cast(1 + event_id * 7919 % 16000 AS int) AS row", "cast(1 + user_id % 6 AS int) AS col",
    "cast(1 + event_id * 7919 % 16000 + user_id % 40 AS int) AS end_row", "cast(2 + user_id % 6 AS int) AS end_col",
    "CASE WHEN event_id % 3 > 0 THEN concat('v', event_id) END AS value", "CASE WHEN event_id % 6 IN (0, 5) THEN concat('=', event_id) END AS formula",
    "cast(CASE WHEN event_id % 8 < 2 THEN 1 + event_id * 104729 % 16000 ELSE 1 + event_id % 9 END AS int) AS index",
    "cast(CASE WHEN event_id % 8 < 2 THEN 1 + event_id % 4 END AS int) AS amount",
)


def edit_log(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").selectExpr(*_LOG)


# Every coordinate walks through the later shifts of its sheet, one at a time.
@REG.add(
    "apply_edits",
    f"""WITH RECURSIVE {fx.CELLS_SQL}, log AS (SELECT {', '.join(p.replace('AS index', 'AS "index"') for p in _LOG)} FROM events),
    steps AS (SELECT path, sheet, CASE WHEN op LIKE '%rows' THEN 'row' ELSE 'col' END AS axis, seq, op LIKE 'delete%' AS gone, "index" AS i,
        coalesce(amount, 1) AS k, row_number() OVER (PARTITION BY path, sheet, op LIKE '%rows' ORDER BY seq) AS n FROM log WHERE op NOT IN ('write', 'clear')),
    begun AS (SELECT path, sheet, 'row' AS axis, row AS x, -1 AS seq, 'up' AS side FROM cells UNION SELECT path, sheet, 'col', col, -1, 'up' FROM cells
      UNION SELECT path, sheet, 'row', row, seq, 'up' FROM log WHERE op IN ('write', 'clear') UNION SELECT path, sheet, 'col', col, seq, 'up' FROM log WHERE op IN ('write', 'clear')
      UNION SELECT path, sheet, 'row', end_row, seq, 'down' FROM log WHERE op = 'clear' UNION SELECT path, sheet, 'col', end_col, seq, 'down' FROM log WHERE op = 'clear'),
    walk AS (SELECT b.path, b.sheet, b.axis, b.x AS x0, b.seq, side, b.x, true AS alive,
        (SELECT count(*) FROM steps s WHERE s.path = b.path AND s.sheet = b.sheet AND s.axis = b.axis AND s.seq < b.seq) AS n FROM begun b
      UNION ALL SELECT w.path, w.sheet, w.axis, x0, w.seq, side, CASE WHEN x < i THEN x WHEN NOT gone THEN x + k WHEN x >= i + k THEN x - k
          WHEN side = 'up' THEN i ELSE i - 1 END, alive AND NOT (gone AND x BETWEEN i AND i + k - 1), w.n + 1
        FROM walk w JOIN steps s ON s.path = w.path AND s.sheet = w.sheet AND s.axis = w.axis AND s.n = w.n + 1),
    ended AS (SELECT * FROM walk w QUALIFY n = max(n) OVER (PARTITION BY path, sheet, axis, x0, seq, side)),
    born AS (SELECT path, sheet, row, col, -1 AS seq, value, formula, cached_value FROM cells
      UNION ALL SELECT path, sheet, row, col, seq, value, formula, NULL FROM log WHERE op = 'write' AND (value IS NULL OR formula IS NULL)),
    placed AS (SELECT b.path, b.sheet, r.x AS row, c.x AS col, b.seq, value, formula, cached_value FROM born b
      JOIN ended r ON r.path = b.path AND r.sheet = b.sheet AND r.axis = 'row' AND r.x0 = b.row AND r.seq = b.seq AND r.side = 'up' AND r.alive
      JOIN ended c ON c.path = b.path AND c.sheet = b.sheet AND c.axis = 'col' AND c.x0 = b.col AND c.seq = b.seq AND c.side = 'up' AND c.alive
      QUALIFY row_number() OVER (PARTITION BY b.path, b.sheet, r.x, c.x ORDER BY b.seq DESC) = 1),
    clears AS (SELECT l.path, l.sheet, l.seq, a.x AS r1, b.x AS c1, c.x AS r2, d.x AS c2 FROM log l
      JOIN ended a ON a.path = l.path AND a.sheet = l.sheet AND a.seq = l.seq AND a.axis = 'row' AND a.side = 'up'
      JOIN ended b ON b.path = l.path AND b.sheet = l.sheet AND b.seq = l.seq AND b.axis = 'col' AND b.side = 'up'
      JOIN ended c ON c.path = l.path AND c.sheet = l.sheet AND c.seq = l.seq AND c.axis = 'row' AND c.side = 'down'
      JOIN ended d ON d.path = l.path AND d.sheet = l.sheet AND d.seq = l.seq AND d.axis = 'col' AND d.side = 'down' WHERE l.op = 'clear')
    SELECT path, sheet, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CASE WHEN NOT hit THEN value END AS value,
      CASE WHEN NOT hit THEN formula END AS formula, CASE WHEN NOT hit THEN cached_value END AS cached_value
    FROM (SELECT p.*, EXISTS (SELECT 1 FROM clears e WHERE e.path = p.path AND e.sheet = p.sheet AND e.seq > p.seq AND p.row BETWEEN r1 AND r2
      AND p.col BETWEEN c1 AND c2) AS hit FROM placed p)""",
)
def _apply_edits(spark, sf_dir):
    return edits.apply_edits(fx.cells(spark, sf_dir), edit_log(spark, sf_dir))[0]


@REG.add(
    "edit_errors",
    f"""WITH log AS (SELECT {', '.join(p.replace('AS index', 'AS "index"') for p in _LOG)} FROM events)
    SELECT path, sheet, seq, 'value_and_formula' AS error FROM log WHERE op = 'write' AND value IS NOT NULL AND formula IS NOT NULL""",
)
def _edit_errors(spark, sf_dir):
    return edits.edit_errors(edit_log(spark, sf_dir)).select("path", "sheet", "seq", "error")


# Overlapping ranges from `lineitem`: single cells, blocks of rows, whole columns.
_RANGES = (
    "concat('book', l_suppkey % 20) AS path", "CASE l_partkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS sheet",
    """concat(substr('ABCDE', 1 + cast(l_partkey % 5 AS int), 1), CASE WHEN l_linenumber = 7 AND l_partkey % 40 = 0 THEN 1 ELSE 1 + l_orderkey END,
      CASE l_linenumber WHEN 1 THEN '' WHEN CASE WHEN l_partkey % 40 = 0 THEN 7 END THEN concat(':', substr('BCDEF', 1 + cast(l_partkey % 5 AS int), 1), '1048576')
        ELSE concat(':$', substr('ABCDE', 1 + cast(l_suppkey % 5 AS int), 1), 1 + l_orderkey + l_partkey % 50) END) AS range""",
    "concat('r', l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey) AS rule",
)
_BOXES_SQL = f"""{fx.CELLS_SQL}, ranges AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(_RANGES)} FROM lineitem),
  cut AS (SELECT *, regexp_extract(replace(range, '$', ''), '^([A-F])([0-9]+)(:([A-F])([0-9]+))?$', ['c', 'r', 'p', 'd', 's']) AS x FROM ranges),
  ends AS (SELECT *, ascii(x.c) - 64 AS c1, TRY_CAST(x.r AS BIGINT) AS r1, CASE WHEN x.p = '' THEN ascii(x.c) - 64 ELSE ascii(x.d) - 64 END AS c2,
    CASE WHEN x.p = '' THEN TRY_CAST(x.r AS BIGINT) ELSE TRY_CAST(x.s AS BIGINT) END AS r2 FROM cut),
  boxes AS (SELECT * REPLACE (least(c1, c2) AS c1, greatest(c1, c2) AS c2, least(r1, r2) AS r1, greatest(r1, r2) AS r2) FROM ends)"""
_MET_SQL = "c.path = b.path AND c.sheet = b.sheet AND c.row BETWEEN r1 AND r2 AND c.col BETWEEN c1 AND c2"
_SHOWN_SQL = "CASE WHEN formula IS NOT NULL THEN cached_value ELSE value END"


def range_rules(spark, sf_dir, *more):
    return fx.table(spark, sf_dir, "lineitem").selectExpr(*_RANGES, *more)


@REG.add(
    "clear_ranges",
    f"""WITH {_BOXES_SQL} SELECT path, sheet, row, col, CASE WHEN NOT hit THEN value END AS value, CASE WHEN NOT hit THEN formula END AS formula,
      CASE WHEN NOT hit THEN cached_value END AS cached_value
    FROM (SELECT c.*, EXISTS (SELECT 1 FROM boxes b WHERE l_linenumber < 7 AND l_suppkey % 4 = 0 AND {_MET_SQL}) AS hit FROM cells c)""",
)
def _clear_ranges(spark, sf_dir):
    lines = range_rules(spark, sf_dir, "l_linenumber", "l_suppkey").filter("l_linenumber < 7 AND l_suppkey % 4 = 0")
    return rectangles.clear_ranges(fx.cells(spark, sf_dir), lines)


_KIND = "CASE l_linenumber % 3 WHEN 0 THEN 'whole' WHEN 1 THEN 'textLength' ELSE 'list' END"


@REG.add(
    "range_violations",
    f"""WITH {_BOXES_SQL}, met AS (SELECT c.path, c.sheet, row, col, rule, l_partkey, l_linenumber, coalesce({_SHOWN_SQL}, '') AS t
      FROM cells c JOIN boxes b ON {_MET_SQL})
    SELECT path, sheet, row, col, rule, t AS value FROM met WHERE CASE WHEN trim(t) = '' THEN l_partkey % 2 = 1
      WHEN l_linenumber % 3 = 0 THEN NOT coalesce(CASE WHEN TRY_CAST(t AS DOUBLE) = floor(TRY_CAST(t AS DOUBLE)) THEN TRY_CAST(t AS DOUBLE) END BETWEEN 20 AND l_partkey, false)
      WHEN l_linenumber % 3 = 1 THEN NOT length(t) < 5 ELSE t NOT IN ('42', '1-URGENT') END""",
)
def _range_violations(spark, sf_dir):
    rules = range_rules(
        spark, sf_dir, f"{_KIND} AS kind", "CASE WHEN l_linenumber % 3 = 1 THEN 'lessThan' END AS operator",
        "CASE WHEN l_linenumber % 3 = 1 THEN '5' ELSE '20' END AS low", "cast(l_partkey AS string) AS high",
        "array('42', '1-URGENT') AS choices", "l_partkey % 2 = 0 AS allow_blank",
    )
    return rectangles.range_violations(fx.cells(spark, sf_dir), rules)


@REG.add(
    "range_flags",
    f"""WITH {_BOXES_SQL} SELECT c.path, c.sheet, row, col, rule FROM cells c JOIN boxes b ON {_MET_SQL}
    WHERE TRY_CAST({_SHOWN_SQL} AS DOUBLE) > 40 AND TRY_CAST({_SHOWN_SQL} AS DOUBLE) > l_partkey""",
)
def _range_flags(spark, sf_dir):
    rules = range_rules(spark, sf_dir, "'greaterThan' AS operator", "greatest(40, l_partkey) AS low", "NULL AS high")
    return rectangles.range_flags(fx.cells(spark, sf_dir), rules)


@REG.add(
    "range_scales",
    f"""WITH {_BOXES_SQL}, met AS (SELECT c.path, c.sheet, row, col, rule, TRY_CAST({_SHOWN_SQL} AS DOUBLE) AS v FROM cells c JOIN boxes b ON {_MET_SQL}
      WHERE TRY_CAST({_SHOWN_SQL} AS DOUBLE) IS NOT NULL),
    s AS (SELECT path, sheet, rule, min(v) AS lo, quantile_cont(v, 0.5) AS mid, max(v) AS hi FROM met GROUP BY 1, 2, 3)
    SELECT path, sheet, row, col, rule, round(CASE WHEN hi = lo THEN 0.0 WHEN v <= mid THEN CASE WHEN mid > lo THEN (v - lo) / (mid - lo) * 0.5 ELSE 0.5 END
      WHEN hi > mid THEN 0.5 + (v - mid) / (hi - mid) * 0.5 ELSE 0.5 END, 6) AS position FROM met JOIN s USING (path, sheet, rule)""",
)
def _range_scales(spark, sf_dir):
    scales = rectangles.range_scales(fx.cells(spark, sf_dir), range_rules(spark, sf_dir))
    return scales.withColumn("position", F.round("position", 6))
