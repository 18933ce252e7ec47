"""Member and settings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Registry
from parlance import fixtures as fx
from parlance.functions import text
from parlance.operators import members as mem
from parlance.operators import settings as cfg

REG = Registry()
QUERIES, ORACLE = REG.queries, REG.oracle

# One request per event: full names, parts of remarks, names nobody has, JSON lists.
_REQUEST_SQL = """CASE event_id % 8
    WHEN 0 THEN 'Remark ' || (event_id % 100)
    WHEN 1 THEN ' customer#00000' || lpad(CAST(event_id % 1000 AS VARCHAR), 4, '0') || ' '
    WHEN 2 THEN '["remark 1' || (event_id % 10) || '", "Remark 1' || (event_id % 10) || '", " ", "' || (event_id % 97) || '"]'
    WHEN 3 THEN 'nobody ' || event_id
    WHEN 4 THEN '[' || event_id || ']'
    WHEN 5 THEN 'k ' || (event_id % 30)
    WHEN 6 THEN '["Customer#", "00' || (event_id % 7) || '%"]'
    ELSE '  ' END"""
_REQUESTS = f"""SELECT event_id AS request_id, 'r' || (user_id % 8) || '@chatroom' AS room,
  {_REQUEST_SQL} AS mentions, event_id % 19 = 0 AS mention_all FROM events"""
REQUESTS_SQL = f"requests AS ({_REQUESTS})"


def requests(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events")
    return rows.selectExpr(
        "event_id AS request_id",
        "concat('r', user_id % 8, '@chatroom') AS room",
        f"{_REQUEST_SQL.replace('VARCHAR', 'STRING')} AS mentions",
        "event_id % 19 = 0 AS mention_all",
    )


# Lists as (pos, mention) rows; a JSON array of anything but strings has no items.
EXPANDED_SQL = f"""{REQUESTS_SQL},
lists AS (SELECT *, trim(mentions) AS t, CASE WHEN trim(mentions) = '' THEN CAST([] AS VARCHAR[])
    WHEN starts_with(trim(mentions), '[') THEN
      CASE WHEN len(list_filter(json_extract(trim(mentions), '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0
      THEN list_filter(list_transform(json_extract_string(trim(mentions), '$[*]'), lambda x: trim(x)), lambda x: x <> '') END
    ELSE [trim(mentions)] END AS items FROM requests),
mentioned AS (SELECT request_id, room, min(i - 1) AS pos, arg_min(items[i], i) AS mention, lower(items[i]) AS keyword
  FROM lists, unnest(range(1, len(items) + 1)) AS r(i) GROUP BY request_id, room, lower(items[i]))"""

_PAIRS_SQL = f"""{EXPANDED_SQL}, {fx.MEMBERS_SQL},
people AS (SELECT chat_room_id AS room, id, wechat_id, coalesce(remark, '') AS remark, coalesce(nickname, '') AS nickname
  FROM members WHERE is_leaved IS NULL OR is_leaved = 0),
keys AS (SELECT DISTINCT room, keyword FROM mentioned),
pairs AS (SELECT k.room, k.keyword, p.id, p.wechat_id, p.remark, p.nickname,
    CASE WHEN lower(p.remark) = k.keyword THEN 1 WHEN lower(p.nickname) = k.keyword THEN 2
      WHEN contains(lower(p.remark), k.keyword) THEN 3 ELSE 4 END AS tier
  FROM keys k JOIN people p ON p.room = k.room
    AND (contains(lower(p.remark), k.keyword) OR contains(lower(p.nickname), k.keyword)))"""

FIRST_SQL = f"""{_PAIRS_SQL},
pool AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY room, keyword ORDER BY id) <= 50),
best AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY room, keyword ORDER BY tier, id) = 1)"""


@REG.add(
    "expand_mentions",
    f"""WITH {EXPANDED_SQL} SELECT request_id, pos, mention FROM mentioned""",
)
def _expand(spark, sf_dir):
    rows = mem.expand_mentions(requests(spark, sf_dir))
    return rows.select("request_id", F.col("pos").cast("long").alias("pos"), "mention")


@REG.add(
    "resolve_members",
    f"""WITH {FIRST_SQL} SELECT m.request_id, m.mention, b.id AS member_id, b.wechat_id, b.tier
    FROM mentioned m LEFT JOIN best b ON b.room = m.room AND b.keyword = m.keyword""",
)
def _resolve(spark, sf_dir):
    rows = mem.expand_mentions(requests(spark, sf_dir))
    found = mem.resolve_members(rows, fx.members(spark, sf_dir))
    return found.select("request_id", "mention", "member_id", "wechat_id", "tier")


_LABEL_SQL = """CASE WHEN remark <> '' AND nickname <> '' AND remark <> nickname
  THEN remark || '（昵称：' || nickname || '）' WHEN remark <> '' THEN remark
  WHEN nickname <> '' THEN nickname ELSE wechat_id END"""


@REG.add(
    "resolve_members_unique",
    f"""WITH {_PAIRS_SQL},
    single AS (SELECT room, keyword, tier, wechat_id, min(id) AS id, arg_min(remark, id) AS remark,
        arg_min(nickname, id) AS nickname FROM pairs GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY room, keyword ORDER BY id) AS nth FROM
      (SELECT * FROM single QUALIFY tier = min(tier) OVER (PARTITION BY room, keyword))),
    found AS (SELECT room, keyword, count(*) AS n, arg_min(wechat_id, id) AS wechat_id,
        arg_min(remark, id) AS remark, arg_min(nickname, id) AS nickname,
        string_agg({_LABEL_SQL}, '、' ORDER BY id) FILTER (nth <= 5) AS labels
      FROM top GROUP BY 1, 2)
    SELECT request_id, mention, CASE WHEN n = 1 THEN wechat_id END AS wechat_id,
      CASE WHEN n = 1 THEN coalesce(nullif(remark, ''), nullif(nickname, ''), mention) END AS display_name,
      CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' END AS error,
      CASE WHEN n > 1 THEN labels END AS labels
    FROM mentioned m LEFT JOIN found f ON f.room = m.room AND f.keyword = m.keyword""",
)
def _resolve_unique(spark, sf_dir):
    rows = mem.expand_mentions(requests(spark, sf_dir))
    found = mem.resolve_members_unique(rows, fx.members(spark, sf_dir))
    return found.select("request_id", "mention", "wechat_id", "display_name", "error", "labels")


@REG.add(
    "mentions",
    f"""WITH {FIRST_SQL},
    resolved AS (SELECT m.*, b.wechat_id FROM mentioned m LEFT JOIN best b ON b.room = m.room AND b.keyword = m.keyword),
    ids AS (SELECT request_id, string_agg(wechat_id, ',' ORDER BY pos) AS ids FROM
      (SELECT request_id, wechat_id, min(pos) AS pos FROM resolved WHERE wechat_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    lost AS (SELECT request_id, string_agg(mention, ',' ORDER BY pos) AS missing FROM resolved WHERE wechat_id IS NULL GROUP BY 1)
    SELECT l.request_id,
      CASE WHEN items IS NULL OR (mention_all AND len(items) > 0) THEN ''
        WHEN mention_all THEN 'notify@all' ELSE coalesce(ids, '') END AS wechat_ids,
      CASE WHEN items IS NULL OR (mention_all AND len(items) > 0) THEN '' ELSE coalesce(missing, '') END AS missing,
      CASE WHEN items IS NULL THEN 'bad_list' WHEN mention_all AND len(items) > 0 THEN 'all_with_names' END AS error
    FROM lists l LEFT JOIN ids USING (request_id) LEFT JOIN lost USING (request_id)""",
)
def _mentions(spark, sf_dir):
    out = mem.mentions(requests(spark, sf_dir), fx.members(spark, sf_dir))
    return out.select(
        "request_id",
        F.array_join("wechat_ids", ",").alias("wechat_ids"),
        F.array_join("missing", ",").alias("missing"),
        "error",
    )


@REG.add(
    "contains_literal",
    f"""WITH {fx.MEMBERS_SQL} SELECT id FROM members WHERE contains(remark, 'k 1')
      OR contains(nickname, '0_1%') OR contains(nickname, '#00')""",
)
def _contains(spark, sf_dir):
    name, remark = F.col("nickname"), F.col("remark")
    test = (
        text.contains_literal(remark, "k 1")
        | text.contains_literal(name, "0_1%")
        | text.contains_literal(name, "#00")
    )
    return fx.members(spark, sf_dir).filter(test).select("id")


_BASE_SQL = f"""{fx.CONVERSATION_IDS_SQL}, {fx.SETTINGS_SQL},
o AS (SELECT c.wx_id, x.* EXCLUDE (wx_id), x.wx_id IS NOT NULL AS has FROM convs c LEFT JOIN overrides x ON x.wx_id = c.wx_id),
b AS (SELECT o.*, g.image_ai_enabled AS g_on, g.image_ai_settings AS g_draw, g.tts_enabled AS g_tts,
  g.tts_model AS g_model, g.tts_settings AS g_set, g.chat_base_url AS g_url, g.chat_api_key AS g_key,
  g.image_recognition_model AS g_rec FROM o, g)"""


def _b(col):
    return f"nullif(trim({col}), '')"


def _bad(*cols):
    return " OR ".join(f"({_b(c)} IS NOT NULL AND NOT json_valid({c}))" for c in cols)


def _obj(col):
    return (
        f"CASE WHEN {_b(col)} IS NOT NULL AND json_valid({col}) AND json_type({col}) = 'OBJECT' "
        f"AND len(json_keys({col})) > 0 THEN trim({col}) END"
    )


@REG.add(
    "settings_drawing",
    f"""WITH {_BASE_SQL} SELECT wx_id, coalesce(image_ai_enabled, g_on, 0) <> 0 AS enabled,
      CASE WHEN NOT ({_bad('image_ai_settings', 'g_draw')}) THEN
        coalesce({_b('image_ai_settings')}, {_b('g_draw')}, '{{}}') END AS settings,
      CASE WHEN {_bad('image_ai_settings', 'g_draw')} THEN 'malformed' END AS error FROM b""",
)
def _drawing(spark, sf_dir):
    return cfg.overlay_drawing(fx.conversation_ids(spark, sf_dir), *fx.settings(spark, sf_dir))


@REG.add(
    "settings_speech",
    f"""WITH {_BASE_SQL} SELECT wx_id, coalesce(tts_enabled, g_tts, 0) <> 0 AS enabled,
      coalesce({_b('tts_model')}, {_b('g_model')}, 'doubao') AS model,
      CASE WHEN NOT ({_bad('tts_settings', 'g_set')}) THEN
        coalesce({_obj('tts_settings')}, {_obj('g_set')}, '{{}}') END AS settings,
      coalesce({_b('chat_base_url')}, {_b('g_url')}, '') AS base_url,
      coalesce({_b('chat_api_key')}, {_b('g_key')}, '') AS api_key,
      CASE WHEN {_bad('tts_settings', 'g_set')} THEN 'malformed' END AS error FROM b""",
)
def _speech(spark, sf_dir):
    return cfg.overlay_tts(fx.conversation_ids(spark, sf_dir), *fx.settings(spark, sf_dir))


def _named(col):
    def one(key):
        return (
            f"CASE WHEN json_type({col}, '$.{key}') = 'VARCHAR' THEN "
            f"nullif(trim(json_extract_string({col}, '$.{key}')), '') END"
        )

    return f"coalesce({one('image_recognition_model')}, {one('imageRecognitionModel')})"


@REG.add(
    "settings_understanding",
    f"""WITH {_BASE_SQL}, m AS (SELECT *, {_obj('g_draw')} AS own,
        coalesce({_obj('image_ai_settings')}, {_obj('g_draw')}) AS merged FROM b)
    SELECT wx_id, coalesce(image_ai_enabled, g_on, 0) <> 0 AS enabled,
      coalesce(CASE WHEN has THEN coalesce({_b('image_recognition_model')}, {_named('merged')}) END,
        {_b('g_rec')}, {_named('own')}, '') AS model,
      CASE WHEN {_bad('image_ai_settings', 'g_draw')} THEN 'malformed' END AS error FROM m""",
)
def _understanding(spark, sf_dir):
    return cfg.overlay_understanding(
        fx.conversation_ids(spark, sf_dir), *fx.settings(spark, sf_dir)
    )


@REG.add(
    "settings_recognition",
    f"""WITH {_BASE_SQL}, u AS (SELECT *, regexp_replace(coalesce({_b('chat_base_url')}, {_b('g_url')}, ''), '/+$', '') AS url FROM b)
    SELECT wx_id, CASE WHEN url = '' OR regexp_matches(url, '/v\\d+$') THEN url ELSE url || '/v1' END AS base_url,
      coalesce({_b('chat_api_key')}, {_b('g_key')}, '') AS api_key,
      coalesce({_b('image_recognition_model')}, {_b('g_rec')}, '') AS model FROM u""",
)
def _recognition(spark, sf_dir):
    return cfg.overlay_recognition(
        fx.conversation_ids(spark, sf_dir), *fx.settings(spark, sf_dir)
    )


_FLAG_SQL = """CASE p_partkey % 9 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'OFF' WHEN 2 THEN 'n' WHEN 3 THEN '1'
  WHEN 4 THEN 'maybe' WHEN 5 THEN NULL WHEN 6 THEN 'TRUE' WHEN 7 THEN '2' ELSE '' END"""


@REG.add(
    "coerce_bool",
    f"""SELECT p_partkey, CASE WHEN f IN ('1', 'true', 'yes', 'y', 'on') THEN true
      WHEN f IN ('0', 'false', 'no', 'n', 'off') THEN false ELSE p_partkey % 2 = 0 END AS flag,
      p_size % 3 <> 0 AS number_flag
    FROM (SELECT p_partkey, p_size, lower(trim({_FLAG_SQL})) AS f FROM part)""",
)
def _coerce_bool(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_size", f"{_FLAG_SQL} AS f"
    )
    flag = F.when(
        F.col("p_partkey") % 2 == 0, text.coerce_bool(F.col("f"), True)
    ).otherwise(text.coerce_bool(F.col("f"), False))
    return rows.select(
        "p_partkey", flag.alias("flag"),
        text.coerce_bool_number(F.col("p_size") % 3).alias("number_flag"),
    )


@REG.add(
    "decode_settings",
    f"""WITH {fx.SETTINGS_SQL} SELECT wx_id, CASE WHEN {_b('tts_settings')} IS NOT NULL AND json_valid(tts_settings)
        AND json_type(tts_settings) = 'OBJECT' THEN len(json_keys(tts_settings)) ELSE 0 END AS keys,
      coalesce(CASE WHEN json_valid(tts_settings) THEN json_extract_string(tts_settings, '$.voice') END, '') AS voice,
      coalesce({_bad('tts_settings')}, false) AS malformed FROM friends""",
)
def _decode(spark, sf_dir):
    friends = fx.settings(spark, sf_dir)[2]
    decoded = text.decode_settings(F.col("tts_settings"))
    return friends.select(
        F.col("wechat_id").alias("wx_id"),
        F.size(decoded).cast("long").alias("keys"),
        F.coalesce(F.element_at(decoded, F.lit("voice")), F.lit("")).alias("voice"),
        text.malformed_json(F.col("tts_settings")).alias("malformed"),
    )


_EMOTION_SQL = """CASE p_partkey % 5 WHEN 0 THEN ' happy ' WHEN 1 THEN 'vocal - fry'
  WHEN 2 THEN 'Happy' WHEN 3 THEN 'ASMR' ELSE p_type END"""
_RATIO_SQL = "CASE p_size % 4 WHEN 0 THEN '16 : 9' WHEN 1 THEN '1:1' WHEN 2 THEN '2:3' ELSE '7:5' END"
_RES_SQL = "CASE p_partkey % 5 WHEN 0 THEN '4 K' WHEN 1 THEN '1440P' WHEN 2 THEN '1024' WHEN 3 THEN '' ELSE '8k' END"


@REG.add(
    "normalize_enum",
    f"""WITH t AS (SELECT p_partkey, trim({_EMOTION_SQL}) AS e, replace({_RATIO_SQL}, ' ', '') AS ratio,
        lower(replace({_RES_SQL}, ' ', '')) AS res FROM part)
    SELECT p_partkey, CASE e WHEN 'vocal - fry' THEN 'vocal-fry' WHEN 'happy' THEN e WHEN 'ASMR' THEN e ELSE '' END AS emotion,
      CASE res || ' ' || ratio WHEN '4k 16:9' THEN '3840x2160' WHEN '4k 1:1' THEN '2048x2048' WHEN '4k 2:3' THEN '2048x3072'
        WHEN '1440p 16:9' THEN '2048x1152' WHEN '1440p 1:1' THEN '2048x2048' WHEN '1440p 2:3' THEN '1360x2048'
        WHEN '1024 16:9' THEN '1536x864' WHEN '1024 1:1' THEN '1024x1024' WHEN '1024 2:3' THEN '1024x1536'
        ELSE 'auto' END AS size FROM t""",
)
def _enum(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"{_EMOTION_SQL} AS e", f"{_RATIO_SQL} AS ratio", f"{_RES_SQL} AS res"
    )
    return rows.select(
        "p_partkey",
        text.emotion(F.col("e")).alias("emotion"),
        text.drawing_size(F.col("ratio"), F.col("res")).alias("size"),
    )


_INT_SQL = """CASE o_orderkey % 7 WHEN 0 THEN ' ' || o_custkey || ' ' WHEN 1 THEN '-' || o_custkey
  WHEN 2 THEN '4.7' WHEN 3 THEN NULL WHEN 4 THEN 'ten' WHEN 5 THEN '99999999999999999999' ELSE '+7' END"""


@REG.add(
    "clamp_int",
    f"""SELECT o_orderkey, CAST(least(greatest(coalesce(CASE WHEN regexp_matches(trim(x), '^[+-]?\\d+$')
      THEN CAST(trim(x) AS HUGEINT) END, 5), 1), 1000) AS INTEGER) AS n
    FROM (SELECT o_orderkey, {_INT_SQL} AS x FROM orders)""",
)
def _clamp(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_INT_SQL} AS x")
    return rows.select("o_orderkey", text.clamp_int(F.col("x"), 5, 1, 1000).alias("n"))
