"""Chat export for every room at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.clock import in_range, local_time
from parlance.functions.text import safe_cell
from parlance.operators.messages import (
    APP,
    TEXT,
    app_fields,
    conversation_kind,
    display_name,
    exclude_sender,
    export_seq,
    is_exportable,
    render_message,
)


def exportable_messages(
    messages: DataFrame, roster: DataFrame, self_id: str, start: int, end: int
) -> DataFrame:
    """Room messages of the range with rendered text and display name, roster fan-out included."""
    picked = messages.filter(
        in_range(F.col("created_at"), start, end) & F.col("type").isin(TEXT, APP)
    )
    picked = exclude_sender(picked, self_id).filter(
        conversation_kind(F.col("from_wxid")) == "room"
    )
    picked = picked.withColumn("app", app_fields(F.col("type"), F.col("content")))
    picked = picked.filter(is_exportable(F.col("type"), F.col("app.type"))).select(
        "id",
        "created_at",
        "sender_wxid",
        "from_wxid",
        render_message(F.col("type"), F.col("content"), F.col("app")).alias("message"),
    )
    names = roster.select(
        F.col("wechat_id").alias("sender_wxid"),
        F.col("chat_room_id").alias("from_wxid"),
        F.col("id").alias("roster_id"),
        "remark",
        "nickname",
    )
    return picked.join(names, ["sender_wxid", "from_wxid"], "left").select(
        F.col("from_wxid").alias("room"),
        "id",
        "created_at",
        "sender_wxid",
        "roster_id",
        display_name(F.col("remark"), F.col("nickname"), F.col("sender_wxid")).alias("sender_name"),
        "message",
    )


def chat_export(
    messages: DataFrame, roster: DataFrame, self_id: str, start: int, end: int,
    limit: int | None = None,
) -> DataFrame:
    """Numbered export rows of every room: room, seq, sent_at, names, message.

    With `limit`, a column `part` cuts each room into parts of so many rows, counted from 1.
    """
    rows = export_seq(exportable_messages(messages, roster, self_id, start, end))
    part = [] if limit is None else [F.expr(f"(seq - 1) DIV {int(limit)} + 1").alias("part")]
    return rows.select(
        "room",
        *part,
        "seq",
        local_time(F.col("created_at")).alias("sent_at"),
        safe_cell(F.col("sender_name")).alias("sender_name"),
        safe_cell(F.col("sender_wxid")).alias("sender_wxid"),
        safe_cell(F.col("message")).alias("message"),
    )
