"""Resolving names that people mention to members of their room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import expand_list, strip
from parlance.operators.matching import containing
from parlance.operators.messages import active_members
from parlance.operators.ordered import dedupe_first, first_rows

# Fixed values.
MENTION_ALL = "notify@all"
CANDIDATES = 50
LABELS = 5


def _folded(col: Column) -> Column:
    return F.lower(strip(F.coalesce(col, F.lit(""))))


def _roster(roster: DataFrame) -> DataFrame:
    return active_members(roster).select(
        F.col("chat_room_id").alias("room"),
        F.col("id").alias("member_id"),
        strip(F.col("wechat_id")).alias("wechat_id"),
        F.lower(F.coalesce(F.col("remark"), F.lit(""))).alias("_remark_text"),
        F.lower(F.coalesce(F.col("nickname"), F.lit(""))).alias("_nickname_text"),
        F.coalesce(strip(F.col("remark")), F.lit("")).alias("remark"),
        F.coalesce(strip(F.col("nickname")), F.lit("")).alias("nickname"),
    )


def _needles(mentions: DataFrame) -> DataFrame:
    keyword = _folded(F.col("mention"))
    return mentions.withColumn("keyword", keyword).filter(F.col("keyword") != "")


def _tier() -> Column:
    """1 exact remark, 2 exact nickname, 3 remark contains, 4 nickname contains; null without any."""
    remark, nickname, keyword = F.lower("remark"), F.lower("nickname"), F.col("keyword")
    return (
        F.when(remark == keyword, 1)
        .when(nickname == keyword, 2)
        .when(F.contains(remark, keyword), 3)
        .when(F.contains(nickname, keyword), 4)
    )


def resolve_members(mentions: DataFrame, roster: DataFrame) -> DataFrame:
    """First match per mention: among the 50 lowest ids whose remark or nickname contains the
    keyword, the best tier, then the lowest id. Unmatched mentions keep a null `wechat_id`.

    `mentions` holds `room` and `mention`. Keywords are matched once per room, not per mention.
    """
    asked = _needles(mentions)
    hits = containing(
        asked, _roster(roster), ["room"], "keyword", ["_remark_text", "_nickname_text"]
    )
    pool = first_rows(hits, ["room", "keyword"], ["member_id"], CANDIDATES)
    ranked = pool.withColumn("tier", _tier()).filter("tier IS NOT NULL")
    best = dedupe_first(ranked, ["room", "keyword"], ["tier", "member_id"])
    return (
        asked.join(
            best.select("room", "keyword", "member_id", "wechat_id", "tier"),
            ["room", "keyword"],
            "left",
        )
        .drop("keyword")
    )


def member_label(remark: Column, nickname: Column, wechat_id: Column) -> Column:
    both = (remark != "") & (nickname != "") & (remark != nickname)
    return (
        F.when(both, F.concat(remark, F.lit("（昵称："), nickname, F.lit("）")))
        .when(remark != "", remark)
        .when(nickname != "", nickname)
        .otherwise(wechat_id)
    )


def resolve_members_unique(mentions: DataFrame, roster: DataFrame) -> DataFrame:
    """Unique match per mention: the first non-empty tier must hold exactly one member.

    Adds wechat_id and display_name, or `error` (`ambiguous` with up to five labels, `not_found`).
    """
    asked = _needles(mentions)
    people = _roster(roster).filter(F.col("wechat_id") != "")
    people = people.withColumn("_remark_text", F.lower("remark"))
    people = people.withColumn("_nickname_text", F.lower("nickname"))
    hits = containing(asked, people, ["room"], "keyword", ["_remark_text", "_nickname_text"])
    member = F.struct("member_id", "remark", "nickname")
    distinct = (
        hits.withColumn("tier", _tier())
        .groupBy("room", "keyword", "tier", "wechat_id")
        .agg(F.min(member).alias("m"))
        .select("room", "keyword", "tier", "wechat_id", "m.*")
    )
    # Six rows settle it: the winner's tier, whether a second member shares it, five labels.
    first = first_rows(
        distinct, ["room", "keyword"], ["tier", "member_id"], LABELS + 1, rank="rank"
    )
    label = member_label(F.col("remark"), F.col("nickname"), F.col("wechat_id"))
    found = first.groupBy("room", "keyword").agg(
        F.min("tier").alias("tier"),
        F.array_sort(
            F.collect_list(F.struct("rank", "tier", "wechat_id", "remark", "nickname",
                                    label.alias("label")))
        ).alias("items"),
    )
    same = F.filter(F.col("items"), lambda x: x["tier"] == F.col("tier"))
    one = F.get(same, F.lit(0))
    shown = F.coalesce(
        F.nullif(one["remark"], F.lit("")), F.nullif(one["nickname"], F.lit("")), F.col("mention")
    )
    many = F.size(same) > 1
    labels = F.array_join(F.transform(F.slice(same, 1, LABELS), lambda x: x["label"]), "、")
    return asked.join(found, ["room", "keyword"], "left").select(
        *mentions.columns,
        F.when(~many, one["wechat_id"]).alias("wechat_id"),
        F.when(~many & one.isNotNull(), shown).alias("display_name"),
        F.when(F.col("items").isNull(), "not_found").when(many, "ambiguous").alias("error"),
        F.when(many, labels).alias("labels"),
    )


def expand_mentions(requests: DataFrame) -> DataFrame:
    """One row per distinct mention of a request, in order, without regard to case.

    `requests` holds request_id, room, mentions (plain text or a JSON list) and mention_all.
    """
    listed = requests.select("request_id", "room", expand_list(F.col("mentions")).alias("_items"))
    folded = listed.withColumn("_folded", F.transform("_items", F.lower))
    # The list belongs to one request row, so first-wins de-duplication needs no shuffle.
    rows = folded.select("request_id", "room", "_folded", F.posexplode("_items").alias("pos", "mention"))
    first = F.array_position("_folded", F.lower("mention")) == F.col("pos") + 1
    return rows.filter(first).drop("_folded")


def _collected(rows: DataFrame, column: str, test: Column, out: str) -> DataFrame:
    """Distinct values per request in order of first mention; a request's own list bounds them."""
    first = rows.filter(test).groupBy("request_id", column).agg(F.min("pos").alias("pos"))
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("v"))))
    return first.groupBy("request_id").agg(F.transform(listed, lambda x: x["v"]).alias(out))


def mentions(requests: DataFrame, roster: DataFrame, unique: bool = False) -> DataFrame:
    """Ids to mention and unresolved names per request; `mention_all` excludes names."""
    rows = expand_mentions(requests)
    resolved = (resolve_members_unique if unique else resolve_members)(rows, roster)
    ids = _collected(resolved, "wechat_id", F.coalesce(F.col("wechat_id") != "", F.lit(False)), "ids")
    lost = _collected(resolved, "mention", F.col("wechat_id").isNull(), "missing")
    named = F.size(expand_list(F.col("mentions"))) > 0
    bad_list = expand_list(F.col("mentions")).isNull()
    empty = F.array().cast("array<string>")
    error = F.when(bad_list, "bad_list").when(F.col("mention_all") & named, "all_with_names")
    return (
        requests.join(ids, "request_id", "left")
        .join(lost, "request_id", "left")
        .select(
            "request_id",
            F.when(error.isNotNull(), empty)
            .when(F.col("mention_all"), F.array(F.lit(MENTION_ALL)))
            .otherwise(F.coalesce("ids", empty))
            .alias("wechat_ids"),
            F.when(error.isNotNull(), empty)
            .otherwise(F.coalesce("missing", empty))
            .alias("missing"),
            error.alias("error"),
        )
    )
