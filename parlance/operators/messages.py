"""Chat log operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.clock import local_time
from parlance.functions.text import blank_to_null, safe_cell, strip
from parlance.operators.ordered import first_rows, running_total

# Message types and the app-message kinds an export keeps.
TEXT, APP, IMAGE, VOICE, VIDEO = 1, 49, 3, 34, 43
EXPORTED_APPS = ("57", "4", "5", "6")
MEDIA_CODES = {"image": IMAGE, "video": VIDEO, "voice": VOICE}
HISTORY_SECONDS = 600
EXPORT_LIMIT = 50_000

_APP_SCHEMA = T.StructType(
    [
        T.StructField(
            "appmsg",
            T.StructType(
                [
                    T.StructField("type", T.ArrayType(T.StringType())),
                    T.StructField("title", T.ArrayType(T.StringType())),
                    T.StructField("des", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("_broken", T.StringType()),
    ]
)


def conversation_kind(col: Column) -> Column:
    return F.when(col.endswith("@chatroom"), "room").otherwise("friend")


def exclude_sender(df: DataFrame, self_id: str) -> DataFrame:
    """Drop the bot's own messages; a null sender drops out too."""
    return df.filter(F.col("sender_wxid") != self_id)


def app_fields(type_: Column, content: Column) -> Column:
    """struct(type, title, des) of an app message; '' for a missing tag, null for broken XML.

    Repeated tags are joined by a blank.
    """
    parsed = F.from_xml(
        content,
        _APP_SCHEMA,
        {
            "rowTag": "msg",
            "ignoreSurroundingSpaces": "false",
            "columnNameOfCorruptRecord": "_broken",
        },
    )

    def fields(xml: Column) -> Column:
        def field(name: str) -> Column:
            texts = F.coalesce(xml["appmsg"][name], F.array().cast("array<string>"))
            return F.when(xml["_broken"].isNull(), F.array_join(texts, " ", "")).alias(name)

        return F.struct(field("type"), field("title"), field("des"))

    # Through a one-element array the XML is parsed once for all three fields.
    return F.when(
        (type_ == APP) & content.isNotNull(), F.get(F.transform(F.array(parsed), fields), F.lit(0))
    )


def is_exportable(type_: Column, subtype: Column) -> Column:
    return (type_ == TEXT) | ((type_ == APP) & subtype.isin(*EXPORTED_APPS))


def render_message(type_: Column, content: Column, app: Column) -> Column:
    """The text an export shows; `app` comes from `app_fields`."""
    kind, title, des = app["type"], app["title"], app["des"]
    return (
        F.when(type_ != APP, content)
        .when(kind == "57", title)
        .when(
            kind.isin("4", "5"),
            F.concat(F.lit("网页分享消息，标题: "), title, F.lit("，描述："), des),
        )
        .when(kind == "6", F.concat(F.lit("文件消息，文件名: "), title))
        .otherwise(des)
    )


def recent_window(df: DataFrame, now: int, seconds: int = HISTORY_SECONDS) -> DataFrame:
    """The last minutes, closed at both ends."""
    return df.filter(F.col("created_at").between(now - seconds, now))


def media_codes(types: list[str]) -> list[int]:
    """Distinct message types for media names in the order given; `all` names every one."""
    names: list[str] = []
    for value in types:
        name = value.strip().lower()
        for one in MEDIA_CODES if name == "all" else (name,):
            if one not in MEDIA_CODES:
                raise ValueError(f"unknown media type: {value}")
            if one not in names:
                names.append(one)
    if not names:
        raise ValueError("no media type given")
    return [MEDIA_CODES[name] for name in names]


def alive(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def active_members(df: DataFrame) -> DataFrame:
    left = F.col("is_leaved")
    return df.filter(left.isNull() | (left == 0))


def with_member(df: DataFrame, roster: DataFrame) -> DataFrame:
    """Left join on (sender, room). People who left still resolve; repeated rows fan out."""
    names = roster.select(
        F.col("wechat_id").alias("sender_wxid"),
        F.col("chat_room_id").alias("from_wxid"),
        "remark",
        "nickname",
    )
    return df.join(names, ["sender_wxid", "from_wxid"], "left")


def display_name(remark: Column, nickname: Column, sender: Column) -> Column:
    return F.coalesce(F.nullif(remark, F.lit("")), F.nullif(nickname, F.lit("")), sender)


def with_room_title(df: DataFrame, contacts: DataFrame, room: str = "room") -> DataFrame:
    """Add `title`: the trimmed nickname of the room's living contact, else the room id."""
    titles = (
        alive(contacts)
        .groupBy(F.col("wechat_id").alias(room))
        .agg(F.min_by(F.struct("nickname"), F.col("id"))["nickname"].alias("_nickname"))
    )
    return (
        df.join(titles, room, "left")
        .withColumn("title", F.coalesce(blank_to_null(F.col("_nickname")), F.col(room)))
        .drop("_nickname")
    )


def with_media_type(df: DataFrame) -> DataFrame:
    """Keep media messages and name their type."""
    names = F.create_map(*[F.lit(x) for name, code in MEDIA_CODES.items() for x in (code, name)])
    typed = df.filter(F.col("type").isin(*MEDIA_CODES.values()))
    return typed.withColumn("media_type", F.element_at(names, F.col("type")))


def referenced_voice(refs: DataFrame, msgs: DataFrame) -> DataFrame:
    """Referenced messages that are voice messages; refs hold `ref_msg_id`."""
    voices = msgs.filter(F.col("type") == VOICE)
    return refs.join(voices, refs["ref_msg_id"] == voices["msg_id"])


def export_seq(df: DataFrame) -> DataFrame:
    """Number messages per room by (created_at, id); a room is cut into minutes."""
    return running_total(
        df,
        keys=["room"],
        order=["created_at", "id", "roster_id"],
        bucket=F.expr("created_at DIV 60"),
        out="seq",
    )


def latest_media(df: DataFrame, n: int = 1) -> DataFrame:
    """The newest n media messages per (room, sender); `newest` counts from the newest one."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    newest = first_rows(df, ["from_wxid", "sender_wxid"], order, n, rank="newest")
    return newest


def media_lists(latest: DataFrame, keys: Sequence[str] = ("from_wxid", "sender_wxid")) -> DataFrame:
    """URL lists per key, oldest first: all and by type, and the rows still to fetch.

    Takes the rows of `latest_media`, hence at most n per group.
    """
    url = strip(F.coalesce(F.col("attachment_url"), F.lit("")))
    rows = latest.withColumn("url", url)
    item = F.struct("created_at", "id", "media_type", "url")
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )

    def urls(kind: str | None) -> Column:
        kept = F.filter(
            F.col("items"),
            lambda x: (x["url"] != "") & (F.lit(True) if kind is None else x["media_type"] == kind),
        )
        return F.transform(kept, lambda x: x["url"])

    return grouped.select(
        *keys,
        urls(None).alias("media_urls"),
        urls("image").alias("image_urls"),
        urls("video").alias("video_urls"),
        urls("voice").alias("voice_urls"),
        F.transform(
            F.filter(F.col("items"), lambda x: x["url"] == ""), lambda x: x["id"]
        ).alias("needs_fetch"),
    )


def overflow_rooms(df: DataFrame, limit: int = EXPORT_LIMIT, room: str = "room") -> DataFrame:
    """Rooms with more messages than one export may hold."""
    return df.groupBy(room).agg(F.count("*").alias("messages")).filter(F.col("messages") > limit)


def chat_order(df: DataFrame) -> DataFrame:
    """Ascending (created_at, id): a range-partitioned sort."""
    return df.orderBy("created_at", "id")


def export_manifest(
    df: DataFrame, contacts: DataFrame, start: int, end: int, exported_at: int
) -> DataFrame:
    """One row per exported room: title, range, message count, time of export."""
    counts = df.groupBy("room").agg(F.count("*").alias("message_count"))
    return with_room_title(counts, contacts).select(
        "room",
        safe_cell(F.col("title")).alias("title"),
        local_time(F.lit(start)).alias("start_time"),
        local_time(F.lit(end)).alias("end_time"),
        "message_count",
        local_time(F.lit(exported_at)).alias("exported_at"),
    )
