"""Chat log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Registry
from parlance import fixtures as fx
from parlance.functions import clock, text
from parlance.operators import messages as msg
from parlance.operators import requests as req
from parlance.plans.chat_export import chat_export, exportable_messages

REG = Registry()
QUERIES, ORACLE = REG.queries, REG.oracle

SELF_ID = "u3"
START, END = clock.resolve_range(start="2024-01-03 08:00", end="2024-01-25 20:30:15")
NOW = 1706000000

# A text message, or an app message whose XML is well formed and of an exported kind.
EXPORTABLE_SQL = f"""{fx.MESSAGES_SQL}, {fx.MEMBERS_SQL},
parsed AS (
  SELECT *, CASE WHEN type = 49 AND content LIKE '%</msg>' THEN regexp_extract(content, '<type>(.*?)</type>', 1) END AS kind,
    regexp_extract(content, '<title>(.*?)</title>', 1) AS title,
    regexp_extract(content, '<des>(.*?)</des>', 1) AS des
  FROM messages),
rendered AS (
  SELECT id, created_at, sender_wxid, from_wxid, CASE WHEN type = 1 THEN content
    WHEN kind = '57' THEN title
    WHEN kind IN ('4', '5') THEN '网页分享消息，标题: ' || title || '，描述：' || des
    WHEN kind = '6' THEN '文件消息，文件名: ' || title END AS message
  FROM parsed
  WHERE (type = 1 OR (type = 49 AND kind IN ('57', '4', '5', '6')))
    AND sender_wxid <> '{SELF_ID}' AND created_at >= {START} AND created_at < {END}),
exported AS (
  SELECT r.from_wxid AS room, r.id, r.created_at, r.sender_wxid, m.id AS roster_id,
    coalesce(nullif(m.remark, ''), nullif(m.nickname, ''), r.sender_wxid) AS sender_name, r.message
  FROM rendered r LEFT JOIN members m ON m.wechat_id = r.sender_wxid AND m.chat_room_id = r.from_wxid)"""


def local_time_sql(col: str) -> str:
    return f"strftime(make_timestamp(CAST({col} AS BIGINT) * 1000000) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S')"


def safe_cell_sql(col: str) -> str:
    clean = (
        f"regexp_replace(coalesce({col}, ''), "
        r"'[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}]', '', 'g')"
    )
    prefix = f"CASE WHEN regexp_matches({clean}, '^[=+\\-@]') THEN '''' ELSE '' END"
    suffix = "'\n……（内容过长，已截断）'"
    return (
        f"({prefix} || CASE WHEN length({clean}) > 32767 - length({prefix}) THEN "
        f"left({clean}, 32767 - length({prefix}) - length({suffix})) || {suffix} ELSE {clean} END)"
    )


@REG.add(
    "chat_export",
    f"""WITH {EXPORTABLE_SQL}
    SELECT room, row_number() OVER (PARTITION BY room ORDER BY created_at, id, roster_id) AS seq,
      {local_time_sql('created_at')} AS sent_at, {safe_cell_sql('sender_name')} AS sender_name,
      {safe_cell_sql('sender_wxid')} AS sender_wxid, {safe_cell_sql('message')} AS message
    FROM exported""",
)
def _chat_export(spark, sf_dir):
    return chat_export(fx.messages(spark, sf_dir), fx.members(spark, sf_dir), SELF_ID, START, END)


@REG.add(
    "message_scan",
    f"WITH {fx.MESSAGES_SQL} SELECT * FROM messages",
)
def _message_scan(spark, sf_dir):
    return fx.messages(spark, sf_dir)


@REG.add(
    "dimension_scan",
    f"""WITH {fx.MEMBERS_SQL} SELECT m.*, {local_time_sql('id')} AS joined_at FROM members m""",
)
def _dimension_scan(spark, sf_dir):
    return fx.members(spark, sf_dir).withColumn("joined_at", clock.local_time(F.col("id")))


_DAY_START, _DAY_END = clock.resolve_range(day="2024-01-09")


@REG.add(
    "time_range_day",
    f"""WITH {fx.MESSAGES_SQL} SELECT id, {local_time_sql('created_at')} AS sent_at FROM messages
    WHERE {local_time_sql('created_at')} LIKE '2024-01-09%'""",
)
def _time_range_day(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).filter(
        clock.in_range(F.col("created_at"), _DAY_START, _DAY_END)
    )
    return rows.select("id", clock.local_time(F.col("created_at")).alias("sent_at"))


@REG.add(
    "conversation_kind",
    f"""WITH {fx.CONVERSATION_IDS_SQL} SELECT CASE WHEN wx_id LIKE '%@chatroom' THEN 'room'
      ELSE 'friend' END AS kind, count(*) AS n FROM convs GROUP BY 1""",
)
def _conversation_kind(spark, sf_dir):
    convs = fx.conversation_ids(spark, sf_dir)
    return convs.groupBy(msg.conversation_kind(F.col("wx_id")).alias("kind")).agg(
        F.count("*").alias("n")
    )


@REG.add(
    "exclude_own_messages",
    f"""WITH {fx.MESSAGES_SQL} SELECT from_wxid, count(*) AS n FROM messages
    WHERE sender_wxid <> '{SELF_ID}' GROUP BY 1""",
)
def _exclude_own(spark, sf_dir):
    rows = msg.exclude_sender(fx.messages(spark, sf_dir), SELF_ID)
    return rows.groupBy("from_wxid").agg(F.count("*").alias("n"))


@REG.add(
    "exportable_messages",
    f"WITH {EXPORTABLE_SQL} SELECT * FROM exported",
)
def _exportable(spark, sf_dir):
    return exportable_messages(
        fx.messages(spark, sf_dir), fx.members(spark, sf_dir), SELF_ID, START, END
    )


@REG.add(
    "render_message",
    f"""WITH {EXPORTABLE_SQL} SELECT id, kind, CASE WHEN type <> 49 THEN content
      WHEN content NOT LIKE '%</msg>' THEN NULL WHEN kind = '57' THEN title
      WHEN kind IN ('4', '5') THEN '网页分享消息，标题: ' || title || '，描述：' || des
      WHEN kind = '6' THEN '文件消息，文件名: ' || title ELSE des END AS message FROM parsed""",
)
def _render(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).withColumn(
        "app", msg.app_fields(F.col("type"), F.col("content"))
    )
    return rows.select(
        "id",
        F.col("app.type").alias("kind"),
        msg.render_message(F.col("type"), F.col("content"), F.col("app")).alias("message"),
    )


@REG.add(
    "recent_window",
    f"""WITH {fx.MESSAGES_SQL} SELECT id, created_at FROM messages
    WHERE created_at BETWEEN {NOW} - 86400 AND {NOW}""",
)
def _recent_window(spark, sf_dir):
    return msg.recent_window(fx.messages(spark, sf_dir), NOW, 86400).select("id", "created_at")


@REG.add(
    "media_types",
    f"""WITH {fx.MESSAGES_SQL} SELECT type, count(*) AS n FROM messages WHERE type IN (43, 34)
    GROUP BY 1""",
)
def _media_types(spark, sf_dir):
    codes = msg.media_codes(["Video", "voice", "video"])
    rows = fx.messages(spark, sf_dir).filter(F.col("type").isin(codes))
    return rows.groupBy("type").agg(F.count("*").alias("n"))


@REG.add(
    "alive_contacts",
    f"WITH {fx.CONTACTS_SQL} SELECT id, wechat_id, nickname FROM contacts WHERE deleted_at IS NULL",
)
def _alive(spark, sf_dir):
    return msg.alive(fx.contacts(spark, sf_dir)).select("id", "wechat_id", "nickname")


@REG.add(
    "active_members",
    f"""WITH {fx.MEMBERS_SQL} SELECT chat_room_id, count(*) AS n FROM members
    WHERE is_leaved IS NULL OR is_leaved = 0 GROUP BY 1""",
)
def _active(spark, sf_dir):
    rows = msg.active_members(fx.members(spark, sf_dir))
    return rows.groupBy("chat_room_id").agg(F.count("*").alias("n"))


@REG.add(
    "message_members",
    f"""WITH {fx.MESSAGES_SQL}, {fx.MEMBERS_SQL} SELECT x.id, m.remark, m.nickname,
      coalesce(nullif(m.remark, ''), nullif(m.nickname, ''), x.sender_wxid) AS shown
    FROM messages x LEFT JOIN members m
      ON m.wechat_id = x.sender_wxid AND m.chat_room_id = x.from_wxid""",
)
def _message_members(spark, sf_dir):
    joined = msg.with_member(fx.messages(spark, sf_dir), fx.members(spark, sf_dir))
    shown = msg.display_name(F.col("remark"), F.col("nickname"), F.col("sender_wxid"))
    return joined.select("id", "remark", "nickname", shown.alias("shown"))


TITLES_SQL = """titles AS (SELECT wechat_id, trim(arg_min(nickname, id)) AS t FROM contacts
  WHERE deleted_at IS NULL GROUP BY 1)"""


@REG.add(
    "room_titles",
    f"""WITH {fx.MESSAGES_SQL}, {fx.CONTACTS_SQL}, {TITLES_SQL}
    SELECT from_wxid AS room, n, coalesce(nullif(t, ''), from_wxid) AS title
    FROM (SELECT from_wxid, count(*) AS n FROM messages GROUP BY 1) LEFT JOIN titles ON wechat_id = from_wxid""",
)
def _room_titles(spark, sf_dir):
    rooms = fx.messages(spark, sf_dir).groupBy(F.col("from_wxid").alias("room"))
    return msg.with_room_title(
        rooms.agg(F.count("*").alias("n")), fx.contacts(spark, sf_dir)
    )


@REG.add(
    "media_type_names",
    f"""WITH {fx.MESSAGES_SQL} SELECT id, CASE type WHEN 3 THEN 'image' WHEN 43 THEN 'video'
      ELSE 'voice' END AS media_type FROM messages WHERE type IN (3, 43, 34)""",
)
def _media_type_names(spark, sf_dir):
    return msg.with_media_type(fx.messages(spark, sf_dir)).select("id", "media_type")


@REG.add(
    "referenced_voice",
    f"""WITH {fx.MESSAGES_SQL} SELECT r.event_id AS asked_by, m.id, m.msg_id FROM events r
    JOIN messages m ON m.msg_id = 'm' || (r.event_id // 2) WHERE m.type = 34""",
)
def _referenced_voice(spark, sf_dir):
    refs = fx.table(spark, sf_dir, "events").selectExpr(
        "event_id AS asked_by", "concat('m', event_id DIV 2) AS ref_msg_id"
    )
    return msg.referenced_voice(refs, fx.messages(spark, sf_dir)).select("asked_by", "id", "msg_id")


@REG.add(
    "latest_media",
    f"""WITH {fx.MESSAGES_SQL} SELECT from_wxid, sender_wxid, id, type, attachment_url, created_at,
      row_number() OVER (PARTITION BY from_wxid, sender_wxid ORDER BY created_at DESC, id DESC) AS newest
    FROM messages WHERE type IN (3, 43, 34) QUALIFY newest <= 9""",
)
def _latest_media(spark, sf_dir):
    rows = fx.messages(spark, sf_dir).select(
        "from_wxid", "sender_wxid", "id", "type", "attachment_url", "created_at"
    )
    media = rows.filter(F.col("type").isin(msg.media_codes(["all"])))
    return msg.latest_media(media, 9).withColumn("newest", F.col("newest").cast("long"))


_MEDIA_LIST_SQL = "coalesce(string_agg(attachment_url, ',' ORDER BY created_at, id) FILTER ({}), '')"


@REG.add(
    "recent_media_lists",
    f"""WITH {fx.MESSAGES_SQL}, newest AS (SELECT * FROM messages WHERE type IN (3, 43, 34)
      AND created_at BETWEEN {NOW} - 600000 AND {NOW}
      QUALIFY row_number() OVER (PARTITION BY from_wxid, sender_wxid ORDER BY created_at DESC, id DESC) <= 5)
    SELECT from_wxid, sender_wxid,
      {_MEDIA_LIST_SQL.format('attachment_url IS NOT NULL')} AS media_urls,
      {_MEDIA_LIST_SQL.format('type = 3 AND attachment_url IS NOT NULL')} AS image_urls,
      {_MEDIA_LIST_SQL.format('type = 43 AND attachment_url IS NOT NULL')} AS video_urls,
      {_MEDIA_LIST_SQL.format('type = 34 AND attachment_url IS NOT NULL')} AS voice_urls,
      coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) FILTER (attachment_url IS NULL), '') AS needs_fetch
    FROM newest GROUP BY 1, 2""",
)
def _recent_media_lists(spark, sf_dir):
    recent = msg.recent_window(msg.with_media_type(fx.messages(spark, sf_dir)), NOW, 600000)
    lists = msg.media_lists(msg.latest_media(recent, 5))
    names = [c for c in lists.columns if c.endswith("urls") or c == "needs_fetch"]
    return lists.select(
        "from_wxid",
        "sender_wxid",
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in names],
    )


@REG.add(
    "overflow_rooms",
    f"""WITH {fx.MESSAGES_SQL} SELECT from_wxid, count(*) AS messages FROM messages GROUP BY 1
    HAVING count(*) > (SELECT count(*) FROM messages) // 8""",
)
def _overflow(spark, sf_dir):
    rows = fx.messages(spark, sf_dir)
    share = rows.agg((F.count("*") / 8).cast("long").alias("n"))
    sizes = msg.overflow_rooms(rows, 0, room="from_wxid")
    return sizes.filter(F.col("messages") > share.scalar())


@REG.add(
    "export_manifest",
    f"""WITH {EXPORTABLE_SQL}, {fx.CONTACTS_SQL}, {TITLES_SQL}
    SELECT room, coalesce(nullif(t, ''), room) AS title, {local_time_sql(str(START))} AS start_time,
      {local_time_sql(str(END))} AS end_time, n AS message_count, {local_time_sql(str(NOW))} AS exported_at
    FROM (SELECT room, count(*) AS n FROM exported GROUP BY 1) LEFT JOIN titles ON wechat_id = room""",
)
def _manifest(spark, sf_dir):
    rows = exportable_messages(
        fx.messages(spark, sf_dir), fx.members(spark, sf_dir), SELF_ID, START, END
    )
    return msg.export_manifest(rows, fx.contacts(spark, sf_dir), START, END, NOW)


@REG.add(
    "chat_order",
    f"""WITH {fx.MESSAGES_SQL} SELECT id, created_at FROM messages ORDER BY created_at, id""",
)
def _chat_order(spark, sf_dir):
    return msg.chat_order(fx.messages(spark, sf_dir).select("id", "created_at"))


@REG.add(
    "parse_local_time",
    """WITH raw AS (SELECT o_orderkey, o_orderdate + INTERVAL (o_orderkey % 86400) SECOND AS t FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 2) THEN CAST(epoch(date_trunc('minute', t)) AS BIGINT) - 28800
      WHEN o_orderkey % 5 IN (1, 3) THEN CAST(epoch(t) AS BIGINT) - 28800 ELSE -1 END AS epoch FROM raw""",
)
def _parse_local(spark, sf_dir):
    stamp = "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)"
    text_of = f"""CASE o_orderkey % 5
        WHEN 0 THEN left(cast({stamp} AS string), 16)
        WHEN 1 THEN cast({stamp} AS string)
        WHEN 2 THEN replace(left(cast({stamp} AS string), 16), ' ', 'T')
        WHEN 3 THEN replace(cast({stamp} AS string), ' ', 'T')
        ELSE '01.02.2024' END"""
    rows = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text_of} AS t")
    return rows.select(
        "o_orderkey", F.coalesce(clock.local_epoch(F.col("t")), F.lit(-1)).alias("epoch")
    )


@REG.add(
    "safe_cells",
    f"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' || text WHEN 1 THEN '@' || chr(7) || text
      WHEN 2 THEN repeat(text, 20) ELSE text END AS x FROM documents)
    SELECT doc_id, md5({safe_cell_sql('x')}) AS digest, length({safe_cell_sql('x')}) AS n FROM t""",
)
def _safe_cells(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """CASE doc_id % 4 WHEN 0 THEN concat('=', text) WHEN 1 THEN concat('@', chr(7), text)
           WHEN 2 THEN repeat(text, 20) ELSE text END AS x""",
    )
    safe = text.safe_cell(F.col("x"))
    return rows.select(
        "doc_id", F.md5(safe).alias("digest"), F.length(safe).cast("long").alias("n")
    )


@REG.add(
    "safe_names",
    r"""SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(
        CASE WHEN doc_id % 9 = 0 THEN ' . ' ELSE '.' || url || ' ?  ' END,
        '[\\/:*?"<>|\x00-\x1F]', '_', 'g'), '\s+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 40), ''), '群聊') AS name
    FROM (SELECT page_id AS doc_id, url FROM pages)""",
)
def _safe_names(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "pages").selectExpr(
        "page_id AS doc_id",
        "CASE WHEN page_id % 9 = 0 THEN ' . ' ELSE concat('.', url, ' ?  ') END AS x",
    )
    return rows.select("doc_id", text.safe_name(F.col("x")).alias("name"))


# One request of every fifth event, at its own time or a little later; some are wrong.
_REQUESTS = (
    "event_id AS request_id", "concat('r', user_id % 8, '@chatroom') AS from_wxid", "concat('u', user_id) AS sender_wxid",
    "{seconds} + event_id % 3 * 40000 AS now", "CASE WHEN event_id % 4 > 0 THEN event_id % 35 % 7 END AS n",
)
_ASKED_SQL = f"""{fx.MESSAGES_SQL}, asked AS (SELECT {', '.join(_REQUESTS).format(seconds='CAST(floor(epoch(ts)) AS BIGINT)')},
  CASE event_id % 6 WHEN 0 THEN ['image'] WHEN 1 THEN [' Video', 'voice', 'video'] WHEN 2 THEN ['all'] WHEN 3 THEN ['photo'] END AS types
  FROM events WHERE event_id % 5 = 0),
good AS (SELECT *, coalesce(n, 1) AS most FROM asked WHERE coalesce(n, 1) >= 1 AND coalesce(types[1], '') <> 'photo'),
found AS (SELECT g.request_id, m.*, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, id DESC) AS newest, most
  FROM good g JOIN messages m ON m.from_wxid = g.from_wxid AND m.sender_wxid = g.sender_wxid AND created_at BETWEEN now - 400000 AND now
    AND type IN (3, 43, 34) AND (types IS NULL OR types[1] = 'all' OR (types[1] = 'image' AND type = 3) OR (types[1] = ' Video' AND type IN (43, 34)))
  QUALIFY newest <= most)"""


def media_requests(spark, sf_dir):
    types = """CASE event_id % 6 WHEN 0 THEN array('image') WHEN 1 THEN array(' Video', 'voice', 'video') WHEN 2 THEN array('all')
      WHEN 3 THEN array('photo') END AS types"""
    kept = [c.format(seconds="unix_seconds(cast(ts AS timestamp))") for c in _REQUESTS]
    return fx.table(spark, sf_dir, "events").filter("event_id % 5 = 0").selectExpr(*kept, types)


@REG.add("requested_media", f"WITH {_ASKED_SQL} SELECT request_id, id, type, created_at, newest FROM found")
def _requested_media(spark, sf_dir):
    rows = req.recent_media(fx.messages(spark, sf_dir), media_requests(spark, sf_dir), 400000)
    return rows.select("request_id", "id", "type", "created_at", F.col("newest").cast("long").alias("newest"))


@REG.add(
    "requested_media_lists",
    f"""WITH {_ASKED_SQL} SELECT g.request_id,
      {_MEDIA_LIST_SQL.format('attachment_url IS NOT NULL')} AS media_urls,
      {_MEDIA_LIST_SQL.format('type = 3 AND attachment_url IS NOT NULL')} AS image_urls,
      {_MEDIA_LIST_SQL.format('type = 43 AND attachment_url IS NOT NULL')} AS video_urls,
      {_MEDIA_LIST_SQL.format('type = 34 AND attachment_url IS NOT NULL')} AS voice_urls,
      coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) FILTER (id IS NOT NULL AND attachment_url IS NULL), '') AS needs_fetch
    FROM good g LEFT JOIN found f ON f.request_id = g.request_id GROUP BY 1""",
)
def _requested_lists(spark, sf_dir):
    lists = req.requested_lists(fx.messages(spark, sf_dir), media_requests(spark, sf_dir), 400000).drop("from_wxid", "sender_wxid")
    names = [c for c in lists.columns if c != "request_id"]
    return lists.select("request_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in names])


@REG.add(
    "request_errors",
    f"""WITH {_ASKED_SQL} SELECT request_id, CASE WHEN n < 1 THEN 'number' ELSE 'type' END AS error FROM asked WHERE n < 1 OR types[1] = 'photo'""",
)
def _request_errors(spark, sf_dir):
    return req.request_errors(media_requests(spark, sf_dir)).select("request_id", "error")


@REG.add(
    "recent_windows",
    f"""WITH {_ASKED_SQL} SELECT request_id, id, created_at FROM asked a JOIN messages m ON m.from_wxid = a.from_wxid AND created_at BETWEEN now - 20000 AND now""",
)
def _recent_windows(spark, sf_dir):
    asked = media_requests(spark, sf_dir).select("request_id", "from_wxid", "now")
    found = req.messages_in_windows(fx.messages(spark, sf_dir), asked, 20000, ("from_wxid",))
    return found.select("request_id", "id", "created_at")
