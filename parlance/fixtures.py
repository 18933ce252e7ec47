"""Chat, page, cell and settings tables derived row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message log from `events`."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "concat('m', event_id) AS msg_id",
        """CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'signup' THEN 43
           WHEN 'error' THEN 34 ELSE 49 END AS type""",
        "concat('r', user_id % 8, '@chatroom') AS from_wxid",
        "concat('u', user_id) AS sender_wxid",
        r"""CASE WHEN event_type = 'click' THEN
              concat(CASE event_id % 7 WHEN 0 THEN '=' WHEN 1 THEN '@' ELSE '' END,
                     'message ', event_id, CASE WHEN event_id % 11 = 0 THEN chr(7) ELSE '' END)
            WHEN event_type = 'purchase' THEN
              concat('<msg><appmsg>',
                     CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('<title>Title ', event_id, '</title>') END,
                     CASE WHEN event_id % 17 = 0 THEN '' ELSE concat('<des>About ', value, '</des>') END,
                     '<type>', element_at(array('57', '4', '5', '6', '33'), cast(event_id % 5 AS int) + 1),
                     '</type></appmsg>', CASE WHEN event_id % 37 = 0 THEN '' ELSE '</msg>' END)
            END AS content""",
        """CASE WHEN event_id % 3 = 0 THEN NULL ELSE
             concat('https://media.example/', event_id) END AS attachment_url""",
        """datediff(cast(ts AS date), date'1970-01-01') * 86400L
             + hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) AS int) AS created_at""",
    )


MESSAGES_SQL = """messages AS (
  SELECT event_id AS id, 'm' || event_id AS msg_id,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'signup' THEN 43
      WHEN 'error' THEN 34 ELSE 49 END AS type,
    'r' || (user_id % 8) || '@chatroom' AS from_wxid, 'u' || user_id AS sender_wxid,
    CASE WHEN event_type = 'click' THEN
        CASE event_id % 7 WHEN 0 THEN '=' WHEN 1 THEN '@' ELSE '' END || 'message ' || event_id
        || CASE WHEN event_id % 11 = 0 THEN chr(7) ELSE '' END
      WHEN event_type = 'purchase' THEN '<msg><appmsg>'
        || CASE WHEN event_id % 13 = 0 THEN '' ELSE '<title>Title ' || event_id || '</title>' END
        || CASE WHEN event_id % 17 = 0 THEN '' ELSE '<des>About ' || value || '</des>' END
        || '<type>' || ['57', '4', '5', '6', '33'][(event_id % 5) + 1] || '</type></appmsg>'
        || CASE WHEN event_id % 37 = 0 THEN '' ELSE '</msg>' END
      END AS content,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'https://media.example/' || event_id END
      AS attachment_url,
    CAST(floor(epoch(ts)) AS BIGINT) AS created_at
  FROM events)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room roster from `customer`: up to three rows per user and room, some users missing."""
    return (
        table(spark, sf_dir, "customer")
        .withColumn("u", F.expr("c_custkey DIV 10"))
        .filter("u % 10 <> 0")
        .selectExpr(
            "c_custkey AS id",
            "concat('r', (u + c_custkey % 4) % 8, '@chatroom') AS chat_room_id",
            "concat('u', u) AS wechat_id",
            """CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN ''
               ELSE concat('Remark ', c_custkey % 100) END AS remark""",
            "CASE WHEN c_custkey % 15 = 0 THEN '' ELSE c_name END AS nickname",
            """CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0
               ELSE CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END END AS is_leaved""",
        )
    )


MEMBERS_SQL = """members AS (
  SELECT c_custkey AS id, 'r' || ((u + c_custkey % 4) % 8) || '@chatroom' AS chat_room_id,
    'u' || u AS wechat_id,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN ''
      ELSE 'Remark ' || (c_custkey % 100) END AS remark,
    CASE WHEN c_custkey % 15 = 0 THEN '' ELSE c_name END AS nickname,
    CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0
      ELSE CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END END AS is_leaved
  FROM (SELECT *, c_custkey // 10 AS u FROM customer) WHERE u % 10 <> 0)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts from `supplier`: rooms and friends, some deleted, blank or repeated."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        """CASE WHEN s_suppkey < 12 THEN concat('r', s_suppkey % 10, '@chatroom')
           ELSE concat('u', s_suppkey) END AS wechat_id""",
        """CASE WHEN s_suppkey % 6 = 3 THEN '   '
           ELSE concat(' ', s_name, ' ') END AS nickname""",
        "CASE WHEN s_suppkey % 5 = 1 THEN s_acctbal END AS deleted_at",
    )


CONTACTS_SQL = """contacts AS (
  SELECT s_suppkey AS id,
    CASE WHEN s_suppkey < 12 THEN 'r' || (s_suppkey % 10) || '@chatroom'
      ELSE 'u' || s_suppkey END AS wechat_id,
    CASE WHEN s_suppkey % 6 = 3 THEN '   ' ELSE ' ' || s_name || ' ' END AS nickname,
    CASE WHEN s_suppkey % 5 = 1 THEN s_acctbal END AS deleted_at
  FROM supplier)"""


def conversation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that need settings, from `customer`: rooms and friends."""
    return table(spark, sf_dir, "customer").selectExpr(
        """CASE WHEN c_custkey % 3 = 0 THEN concat('r', c_custkey, '@chatroom')
           ELSE concat('u', c_custkey) END AS wx_id"""
    )


CONVERSATION_IDS_SQL = """convs AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN 'r' || c_custkey || '@chatroom'
    ELSE 'u' || c_custkey END AS wx_id FROM customer)"""

_SETTINGS = (
    "CASE {k} % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS image_ai_enabled",
    """CASE {k} % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN '{{}}'
       WHEN 4 THEN '{{"model":"m1","n":1}}' WHEN 5 THEN '{{"imageRecognitionModel":" vision "}}'
       ELSE '{{"image_recognition_model":7,"imageRecognitionModel":"alt"}}' END
       AS image_ai_settings""",
    "CASE {k} % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END AS tts_enabled",
    "CASE {k} % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE ' tts-a ' END AS tts_model",
    """CASE {k} % 6 WHEN 0 THEN NULL WHEN 1 THEN '{{}}' WHEN 2 THEN '[1]'
       WHEN 3 THEN '{{"voice":"a"}}' WHEN 4 THEN '  ' ELSE '{{"broken":' END AS tts_settings""",
    """CASE {k} % 5 WHEN 0 THEN 'https://api.example/' WHEN 1 THEN ' https://api.example/v3 '
       WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'https://api.example/v2x//' END AS chat_base_url""",
    "CASE {k} % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'key-{tag}' END AS chat_api_key",
    """CASE {k} % 6 WHEN 0 THEN ' model-{tag} ' WHEN 1 THEN '' ELSE NULL END
       AS image_recognition_model""",
)


def _settings(key: str, tag: str) -> list[str]:
    return [column.format(k=key, tag=tag) for column in _SETTINGS]


def settings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one global row, room rows, friend rows) from `region`, `supplier` and `part`."""
    from_region = table(spark, sf_dir, "region").filter("r_regionkey = 4")
    from_supplier = table(spark, sf_dir, "supplier")
    from_part = table(spark, sf_dir, "part")

    room_id = "concat('r', s_suppkey * 3, '@chatroom') AS chat_room_id"
    return (
        from_region.selectExpr(*_settings("r_regionkey", "global")),
        from_supplier.selectExpr(room_id, *_settings("s_suppkey", "room")),
        from_part.selectExpr(
            "concat('u', p_partkey) AS wechat_id", *_settings("p_partkey", "friend")
        ),
    )


def _settings_sql(key: str, tag: str) -> str:
    return ", ".join(_settings(key, tag))


SETTINGS_SQL = f"""g AS (SELECT {_settings_sql('r_regionkey', 'global')} FROM region WHERE r_regionkey = 4),
rooms AS (SELECT 'r' || (s_suppkey * 3) || '@chatroom' AS wx_id, {_settings_sql('s_suppkey', 'room')} FROM supplier),
friends AS (SELECT 'u' || p_partkey AS wx_id, {_settings_sql('p_partkey', 'friend')} FROM part),
overrides AS (SELECT * FROM rooms UNION ALL SELECT * FROM friends)"""


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractions per page from `conversations`; the first engine's text is partly damaged."""
    base = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS doc_id",
        "cast(turn + 1 AS int) AS page",
        "text",
        "(conv_id * 7 + turn * 13) % 100 / 100D AS image_coverage",
        "conv_id * 11 + turn * 5 AS k",
    )
    damaged = F.expr(
        r"""CASE WHEN conv_id_k % 9 = 0 THEN concat(text, ' (cid:1)(CID:22) (cid:3)')
             WHEN conv_id_k % 9 = 1 THEN concat(text, repeat('\uFFFD', 4))
             WHEN conv_id_k % 9 = 2 THEN concat(repeat('\u2E82', 3), left(text, 300))
             WHEN conv_id_k % 9 = 3 THEN left(text, 18)
             WHEN conv_id_k % 9 = 4 THEN concat(text, chr(1), chr(2), chr(3))
             WHEN conv_id_k % 9 = 5 THEN concat(' 3 / 12 ', chr(10), left(text, 9))
             WHEN conv_id_k % 27 = 6 THEN ' ' ELSE text END"""
    )
    first = base.withColumnRenamed("k", "conv_id_k").select(
        "doc_id", "page", F.lit("primary").alias("engine"), F.lit(0).alias("engine_order"),
        damaged.alias("text"), "image_coverage",
    )
    second = base.select(
        "doc_id", "page", F.lit("fallback").alias("engine"), F.lit(1).alias("engine_order"),
        F.expr("CASE WHEN k % 14 = 5 THEN left(text, 12) ELSE text END").alias("text"),
        "image_coverage",
    )
    return first.unionByName(second)


PAGE_CANDIDATES_SQL = r"""base AS (
  SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text,
    ((conv_id * 7 + turn * 13) % 100) / 100.0::DOUBLE AS image_coverage,
    conv_id * 11 + turn * 5 AS k FROM conversations),
cands AS (
  SELECT doc_id, page, 'primary' AS engine, 0 AS engine_order,
    CASE WHEN k % 9 = 0 THEN text || ' (cid:1)(CID:22) (cid:3)'
      WHEN k % 9 = 1 THEN text || repeat(chr(65533), 4)
      WHEN k % 9 = 2 THEN repeat(chr(11906), 3) || left(text, 300)
      WHEN k % 9 = 3 THEN left(text, 18)
      WHEN k % 9 = 4 THEN text || chr(1) || chr(2) || chr(3)
      WHEN k % 9 = 5 THEN ' 3 / 12 ' || chr(10) || left(text, 9)
      WHEN k % 27 = 6 THEN ' ' ELSE text END AS text, image_coverage FROM base
  UNION ALL
  SELECT doc_id, page, 'fallback', 1, CASE WHEN k % 14 = 5 THEN left(text, 12) ELSE text END,
    image_coverage FROM base)"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents` as numbered paragraphs."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "posexplode(split(text, '\\n')) AS (pos, text)"
    )


PARAGRAPHS_SQL = """paras AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, string_split(text, chr(10))[i] AS text
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell grid from `orders`: five columns per order, with formulas, errors and blanks."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('book', o_custkey % 20) AS path",
        "o_orderstatus AS sheet",
        "cast(o_orderkey + 1 AS int) AS row",
        """stack(5,
          1, cast(o_orderkey AS string), cast(NULL AS string), cast(NULL AS string),
          2, CASE WHEN o_orderkey % 29 = 0 THEN '#REF!' ELSE cast(o_custkey AS string) END, NULL, NULL,
          3, o_orderpriority, NULL, NULL,
          4, CASE WHEN o_orderkey % 31 = 0 THEN ' #n/a ' ELSE '' END, NULL, NULL,
          5, NULL, CASE WHEN o_orderkey % 10 = 0 THEN concat('=XLOOKUP(A', o_orderkey + 1, ',B:B,C:C)')
                   WHEN o_orderkey % 10 = 1 THEN concat('=SUM(A1:A', o_orderkey + 1, ')')
                   ELSE concat('=A', o_orderkey + 1, '*2') END,
             CASE WHEN o_orderkey % 7 = 0 THEN '#DIV/0!' WHEN o_orderkey % 7 = 1 THEN ' #name? '
                  WHEN o_orderkey % 7 = 2 THEN NULL ELSE '42' END)
          AS (col, value, formula, cached_value)""",
    )


CELLS_SQL = """cells AS (
  SELECT 'book' || (o_custkey % 20) AS path, o_orderstatus AS sheet,
    CAST(o_orderkey + 1 AS INTEGER) AS row, col,
    CASE col WHEN 1 THEN CAST(o_orderkey AS VARCHAR)
      WHEN 2 THEN CASE WHEN o_orderkey % 29 = 0 THEN '#REF!' ELSE CAST(o_custkey AS VARCHAR) END
      WHEN 3 THEN o_orderpriority
      WHEN 4 THEN CASE WHEN o_orderkey % 31 = 0 THEN ' #n/a ' ELSE '' END END AS value,
    CASE WHEN col = 5 THEN CASE WHEN o_orderkey % 10 = 0 THEN '=XLOOKUP(A' || (o_orderkey + 1) || ',B:B,C:C)'
      WHEN o_orderkey % 10 = 1 THEN '=SUM(A1:A' || (o_orderkey + 1) || ')'
      ELSE '=A' || (o_orderkey + 1) || '*2' END END AS formula,
    CASE WHEN col = 5 THEN CASE WHEN o_orderkey % 7 = 0 THEN '#DIV/0!'
      WHEN o_orderkey % 7 = 1 THEN ' #name? ' WHEN o_orderkey % 7 = 2 THEN NULL ELSE '42' END END
      AS cached_value
  FROM orders, (VALUES (1), (2), (3), (4), (5)) AS c(col))"""


def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): every document as a ragged comma separated file, one cell per word."""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('doc', doc_id, '.csv') AS path",
        """encode(replace(replace(replace(trim(BOTH '\\n' FROM text), '"', ''), ',', ''), ' ', ','),
             'UTF-8') AS content""",
    )


def _build_packages(batches):
    import io
    import zipfile

    import pandas as pd

    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    relation = "http://schemas.openxmlformats.org/package/2006/relationships"
    types = "http://schemas.openxmlformats.org/package/2006/content-types"

    def build(k: int, n: int) -> bytes:
        marks = "".join(
            f'<w:commentRangeStart w:id="{i}"/>'
            + ("" if i % 5 == 0 else f'<w:commentRangeEnd w:id="{i}"/>')
            + ("" if i % 7 == 0 else f'<w:commentReference w:id="{i}"/>')
            for i in range(k % 9)
        )
        changes = "".join(
            f'<w:ins w:author="a{i % 3}" w:date="2024-01-01"/>' if i % 2 else '<w:del w:id="1"/>'
            for i in range(n % 6)
        )
        parts = [
            ("[Content_Types].xml",
             f'<Types xmlns="{types}"><Override PartName="/word/document.xml" ContentType="doc"/>'
             f'<Override PartName="/word/gone{k}.xml" ContentType="x"/>'
             + ('<Override PartName="/word/document.xml" ContentType="doc"/>' if k % 6 == 0 else "")
             + "</Types>"),
            ("_rels/.rels",
             f'<Relationships xmlns="{relation}"><Relationship Id="r1" Target="word/document.xml"/>'
             + ('<Relationship Id="r1" Target="/word/lost.xml"/>' if k % 4 == 0 else "")
             + ('<Relationship Id="r2" Target="../out.xml"/>' if k % 11 == 0 else "")
             + '<Relationship Id="r3" Target="https://example.org" TargetMode="External"/>'
             + '<Relationship Id="r4" Target="#top"/></Relationships>'),
            ("word/document.xml",
             f'<w:document xmlns:w="{word}"><w:body>{marks}{changes}</w:body></w:document>'),
            ("word/comments.xml",
             f'<w:comments xmlns:w="{word}">'
             + "".join(f'<w:comment w:id="{i}"/>' for i in range(k % 4)) + "</w:comments>"),
        ]
        if k % 5 == 0:
            parts = [part for part in parts if part[0] != "_rels/.rels"]
        if k % 3 == 0:
            parts.append(("word/media/image1.png", "x" * (n % 50)))
        if k % 13 == 0:
            parts.append(("../evil.xml", "<broken"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name, body in parts:
                archive.writestr(zipfile.ZipInfo(name), body)
        return out.getvalue()

    for batch in batches:
        yield pd.DataFrame(
            {
                "path": [f"p{k}.docx" for k in batch["doc_id"]],
                "content": [
                    build(int(k), int(n)) for k, n in zip(batch["doc_id"], batch["n_chars"])
                ],
            }
        )


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a small document package per document, with planted defects."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.mapInPandas(_build_packages, "path string, content binary")


# Lines of `documents` as OCR lines, twenty to a page of 1000 x 1400 units.
_OCR = (
    "doc_id", "cast(1 + pos DIV 20 AS int) AS page", "cast(pos % 20 AS int) AS idx",
    "concat(' ', text, CASE WHEN pos % 7 = 0 THEN concat(chr(9), ' ') ELSE '' END) AS text",
    "CASE WHEN pos % 23 = 5 THEN NULL ELSE (doc_id * 7 + pos * 31) % 120 / 100D END AS confidence",
    """CASE WHEN pos % 17 <> 3 THEN array(array(bx, by), array(bx + 200D, by), array(bx + 200D, by + 40D),
         array(bx, by + 40D)) END AS box""",
    "1000 AS page_width", "1400 AS page_height",
)


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(spark, sf_dir).filter("text <> ''")
    rows = rows.withColumn("bx", F.expr("cast((doc_id * 37 + pos * 53) % 700 AS double)"))
    rows = rows.withColumn("by", F.expr("(pos % 20) * 60 + pos * 7 % 13 + 0.125D"))
    return rows.selectExpr(*_OCR)


OCR_SQL = f"""{PARAGRAPHS_SQL},
ocr AS (SELECT doc_id, CAST(1 + pos // 20 AS INTEGER) AS page, CAST(pos % 20 AS INTEGER) AS idx, pos, text,
    CASE WHEN pos % 23 = 5 THEN 0.0::DOUBLE ELSE least(1.0, ((doc_id * 7 + pos * 31) % 120) / 100.0::DOUBLE) END AS confidence,
    pos % 17 <> 3 AS boxed, CAST((doc_id * 37 + pos * 53) % 700 AS DOUBLE) AS bx,
    CAST((pos % 20) * 60 + pos * 7 % 13 AS DOUBLE) + 0.125::DOUBLE AS by_ FROM paras WHERE text <> ''),
lines AS (SELECT *, CASE WHEN boxed THEN bx ELSE idx END AS "left",
    CAST(round_even(CASE WHEN boxed THEN round_even(by_, 2) ELSE idx END / 10, 0) AS BIGINT) AS band,
    trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS clean FROM ocr)"""

def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rectangles on some of the OCR pages."""
    return paragraphs(spark, sf_dir).filter("pos % 5 = 0 AND doc_id % 4 <> 3").selectExpr(
        "doc_id", "cast(1 + pos DIV 20 AS int) AS page",
        "cast((doc_id * 13 + pos * 29) % 900 AS double) AS x0",
        "cast(pos * 61 % 1300 AS double) AS top",
        "cast((doc_id * 13 + pos * 29) % 900 + 20 + pos * 17 % 400 AS double) AS x1",
        "cast(pos * 61 % 1300 + 20 + doc_id % 600 AS double) + 0.123D AS bottom",
        "1000D AS width", "1400D AS height",
    )


IMAGES_SQL = f"""boxes AS (SELECT doc_id, page, x0 / 1000 AS x0, y0 / 1400 AS y0, least(1000, x1) / 1000 AS x1, least(1400, y1) / 1400 AS y1 FROM
  (SELECT doc_id, CAST(1 + pos // 20 AS INTEGER) AS page, CAST((doc_id * 13 + pos * 29) % 900 AS DOUBLE) AS x0,
    CAST(pos * 61 % 1300 AS DOUBLE) AS y0, CAST((doc_id * 13 + pos * 29) % 900 + 20 + pos * 17 % 400 AS DOUBLE) AS x1,
    CAST(pos * 61 % 1300 + 20 + doc_id % 600 AS DOUBLE) + 0.123::DOUBLE AS y1 FROM paras WHERE pos % 5 = 0 AND doc_id % 4 <> 3))"""


def native_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native text behind every third OCR line: equal, extended or partly changed."""
    from parlance.functions.text import match_key

    rows = paragraphs(spark, sf_dir).filter("text <> '' AND pos % 3 = 0")
    rows = rows.withColumn("bx", F.expr("cast((doc_id * 37 + pos * 53) % 700 AS double)"))
    rows = rows.withColumn("by", F.expr("(pos % 20) * 60 + pos * 7 % 13"))
    text = F.expr(
        """CASE pos % 9 WHEN 0 THEN text WHEN 3 THEN concat(text, ' and more') ELSE
           translate(text, 'et', '37') END"""
    )
    return rows.select(
        "doc_id", F.expr("cast(1 + pos DIV 20 AS int)").alias("page"), match_key(text).alias("key"),
        (F.col("bx") / 1000).alias("x0"), (F.col("by") / 1400).alias("y0"),
        ((F.col("bx") + 200) / 1000).alias("x1"), ((F.col("by") + 40) / 1400).alias("y1"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` placed on pages: ten to a line, twenty lines to a page."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "posexplode(filter(split(text, '[ \\\\n]+'), w -> w <> '')) AS (pos, text)"
    )
    return docs.selectExpr(
        "doc_id", "cast(1 + pos DIV 200 AS int) AS page", "pos AS idx", "text",
        "cast(20 + (pos % 10) * 55 + pos % 3 AS double) AS x0",
        "20 + (pos % 200 DIV 10) * 14 + (pos * 7 % 5) * 0.6D AS top",
        "cast(70 + (pos % 10) * 55 AS double) AS x1",
        "32 + (pos % 200 DIV 10) * 14 + (pos * 7 % 5) * 0.6D AS bottom",
        "600D AS width", "400D AS height",
    )
