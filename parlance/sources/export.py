"""Chat export files: data rows per room and one manifest, there together or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The header of an exported room.
HEADER = {
    "seq": "序号",
    "sent_at": "发送时间",
    "sender_name": "发送人",
    "sender_wxid": "发送人微信 ID",
    "message": "消息内容",
}


class ExportError(ValueError):
    """The rows written and the manifest do not agree."""


def _write_rows(rows: DataFrame, path: str) -> None:
    named = rows.select("room", *[rows[c].alias(title) for c, title in HEADER.items()])
    (
        named.repartitionByRange("room", HEADER["seq"])
        .sortWithinPartitions("room", HEADER["seq"])
        .write.partitionBy("room")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def written_counts(spark: SparkSession, path: str) -> DataFrame:
    """room, message_count of the rows in export files."""
    schema = ", ".join(f"`{title}` string" for title in HEADER.values())
    files = spark.read.schema(f"{schema}, room string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return files.groupBy("room").agg(F.count("*").alias("message_count"))


def write_export(rows: DataFrame, manifest: DataFrame, path: str) -> None:
    """Write `path/rooms/room=.../*.csv` in message order and `path/manifest`, in one step.

    Both are written into a folder beside `path`, which takes its place by a rename once all is there
    and each room of the manifest has as many rows in the files as it says; an earlier export is
    replaced. If a task fails, or the counts differ (ExportError), the folder is removed and `path`
    stays as it was. Ranges over (room, seq) let a busy room fill several files; file order is message order.
    """
    spark = rows.sparkSession
    staged, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("writing", "replaced"))
    jvm = spark.sparkContext._jvm
    place, work, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged, old))
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        _write_rows(rows, f"{staged}/rooms")
        manifest.write.json(f"{staged}/manifest")
        said = spark.read.schema(manifest.schema).json(f"{staged}/manifest").select(F.col("room").alias("_room"), F.col("message_count").alias("_said"))
        # Without any row there are no files to read.
        there = written_counts(spark, f"{staged}/rooms") if rows.limit(1).count() else spark.createDataFrame([], "room string, message_count long")
        both = there.join(said, F.col("room").eqNullSafe(F.col("_room")), "full").filter(~F.col("message_count").eqNullSafe(F.col("_said")))
        wrong = both.select(F.coalesce("room", "_room"), "message_count", "_said").limit(3).collect()
        if wrong:
            raise ExportError(f"rooms, rows written and rows of the manifest: {[tuple(w) for w in wrong]}")
        if store.exists(place) and not store.rename(place, aside):
            raise OSError(f"cannot replace {path}")
        if not store.rename(work, place):
            if store.exists(aside):
                store.rename(aside, place)
            raise OSError(f"cannot move the export to {path}")
    finally:
        for left in (work, aside):
            if store.exists(left) and (left is work or store.exists(place)):
                store.delete(left, True)
