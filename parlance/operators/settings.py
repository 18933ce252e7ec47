"""Layered settings: one global row, overridden per room or friend.

Every overlay takes the conversation ids (`wx_id`), the global table and the two override tables.
The global row enters as a scalar subquery; overrides arrive by an equi-join on the id.
Settings text that is no JSON is reported in `error` instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import blank_to_null, malformed_json, strip
from parlance.operators.messages import conversation_kind

DEFAULT_TTS_MODEL = "doubao"


def _present(df: DataFrame, fields: Sequence[str]) -> list[Column]:
    """The wanted columns; one the table lacks reads as null."""
    return [
        (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in fields
    ]


def _joined(
    convs: DataFrame, globals_: DataFrame, rooms: DataFrame, friends: DataFrame,
    fields: Sequence[str],
) -> tuple[DataFrame, Column, Column]:
    """(conversations with the structs, global struct, override struct)."""
    # Of several global rows the least, as of several overrides of one conversation.
    base = globals_.agg(F.min(F.struct(*_present(globals_, fields))).alias("g"))

    def keyed(df: DataFrame, key: str, kind: str) -> DataFrame:
        ids = df.filter(conversation_kind(F.col(key)) == kind)
        return ids.groupBy(F.col(key).alias("wx_id")).agg(
            F.min(F.struct(*_present(df, fields))).alias("o")
        )

    overrides = keyed(rooms, "chat_room_id", "room").unionByName(
        keyed(friends, "wechat_id", "friend")
    )
    rows = convs.join(overrides, "wx_id", "left").withColumn("g", base.scalar())
    return rows, F.col("g"), F.col("o")


def _text(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit(""))


def _object(col: Column) -> Column:
    """The JSON text when it is an object with at least one key, else null."""
    value = F.try_parse_json(col)
    keys = F.json_object_keys(F.when(value.isNotNull() & strip(col).startswith("{"), col))
    return F.when(F.size(keys) > 0, strip(col))


def _flag(col: Column) -> Column:
    return col.cast("int") != 0


def overlay_drawing(
    convs: DataFrame, globals_: DataFrame, rooms: DataFrame, friends: DataFrame
) -> DataFrame:
    """wx_id, enabled, settings: an override's JSON replaces whenever it is not blank, even `{}`."""
    rows, g, o = _joined(
        convs, globals_, rooms, friends, ["image_ai_enabled", "image_ai_settings"]
    )
    raw_g, raw_o = blank_to_null(g["image_ai_settings"]), blank_to_null(o["image_ai_settings"])
    broken = malformed_json(raw_g) | malformed_json(raw_o)
    return rows.select(
        "wx_id",
        F.coalesce(_flag(o["image_ai_enabled"]), _flag(g["image_ai_enabled"]), F.lit(False))
        .alias("enabled"),
        F.when(~broken, F.coalesce(raw_o, raw_g, F.lit("{}"))).alias("settings"),
        F.when(broken, "malformed").alias("error"),
    )


def overlay_tts(
    convs: DataFrame, globals_: DataFrame, rooms: DataFrame, friends: DataFrame
) -> DataFrame:
    """wx_id, enabled, model, settings, base_url, api_key: JSON replaces only when it is a
    non-empty object; the model defaults to a fixed name; URL and key overlay when not blank."""
    rows, g, o = _joined(
        convs, globals_, rooms, friends,
        ["tts_enabled", "tts_model", "tts_settings", "chat_base_url", "chat_api_key"],
    )
    # A JSON text that is no object counts as {}.
    raw_g, raw_o = blank_to_null(g["tts_settings"]), blank_to_null(o["tts_settings"])
    broken = malformed_json(raw_g) | malformed_json(raw_o)

    def overlaid(name: str) -> Column:
        return F.coalesce(blank_to_null(o[name]), blank_to_null(g[name]), F.lit(""))

    return rows.select(
        "wx_id",
        F.coalesce(_flag(o["tts_enabled"]), _flag(g["tts_enabled"]), F.lit(False)).alias("enabled"),
        F.coalesce(
            blank_to_null(o["tts_model"]), blank_to_null(g["tts_model"]), F.lit(DEFAULT_TTS_MODEL)
        ).alias("model"),
        F.when(~broken, F.coalesce(_object(raw_o), _object(raw_g), F.lit("{}"))).alias("settings"),
        overlaid("chat_base_url").alias("base_url"),
        overlaid("chat_api_key").alias("api_key"),
        F.when(broken, "malformed").alias("error"),
    )


def _model_in(settings: Column) -> Column:
    """The model named inside a settings object, under either spelling, if it is text."""
    value = F.try_parse_json(settings)

    def named(key: str) -> Column:
        item = F.try_variant_get(value, f"$.{key}", "variant")
        return F.when(
            F.schema_of_variant(item) == "STRING",
            blank_to_null(F.try_variant_get(value, f"$.{key}", "string")),
        )

    return F.coalesce(named("image_recognition_model"), named("imageRecognitionModel"))


def overlay_understanding(
    convs: DataFrame, globals_: DataFrame, rooms: DataFrame, friends: DataFrame
) -> DataFrame:
    """wx_id, enabled, model: the model comes from its column, else from the settings JSON; the
    override looks into the merged JSON. Tables without the model column are fine."""
    rows, g, o = _joined(
        convs, globals_, rooms, friends,
        ["image_ai_enabled", "image_ai_settings", "image_recognition_model"],
    )
    raw_g, raw_o = blank_to_null(g["image_ai_settings"]), blank_to_null(o["image_ai_settings"])
    broken = malformed_json(raw_g) | malformed_json(raw_o)
    own = _object(raw_g)
    merged = F.coalesce(_object(raw_o), own)
    model_g = F.coalesce(blank_to_null(g["image_recognition_model"]), _model_in(own))
    model_o = F.when(
        o.isNotNull(),
        F.coalesce(blank_to_null(o["image_recognition_model"]), _model_in(merged)),
    )
    return rows.select(
        "wx_id",
        F.coalesce(_flag(o["image_ai_enabled"]), _flag(g["image_ai_enabled"]), F.lit(False))
        .alias("enabled"),
        F.when(~broken, F.coalesce(model_o, model_g, F.lit(""))).alias("model"),
        F.when(broken, "malformed").alias("error"),
    )


def versioned_url(col: Column) -> Column:
    """Base URL without trailing slashes, ending in a version."""
    url = F.regexp_replace(col, "/+$", "")
    return F.when((url == "") | url.rlike(r"/v\d+$"), url).otherwise(F.concat(url, F.lit("/v1")))


def overlay_recognition(
    convs: DataFrame, globals_: DataFrame, rooms: DataFrame, friends: DataFrame
) -> DataFrame:
    """wx_id, base_url, api_key, model: each field overlays on its own when not blank."""
    rows, g, o = _joined(
        convs, globals_, rooms, friends,
        ["chat_base_url", "chat_api_key", "image_recognition_model"],
    )

    def overlaid(name: str) -> Column:
        return F.coalesce(blank_to_null(o[name]), blank_to_null(g[name]), F.lit(""))

    return rows.select(
        "wx_id",
        versioned_url(overlaid("chat_base_url")).alias("base_url"),
        overlaid("chat_api_key").alias("api_key"),
        overlaid("image_recognition_model").alias("model"),
    )
