"""Table scans. A source is a Parquet path or JDBC options; filters push down in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGE_COLUMNS = (
    "id", "msg_id", "type", "from_wxid", "sender_wxid", "content", "attachment_url", "created_at",
)


def _read(spark: SparkSession, src: str | dict, table: str | None = None) -> DataFrame:
    if isinstance(src, str):
        return spark.read.parquet(src)
    options = dict(src)
    if table is not None:
        options["dbtable"] = table
    return spark.read.format("jdbc").options(**options).load()


def read_messages(spark: SparkSession, src: str | dict) -> DataFrame:
    """Message log. JDBC sources read in parallel ranges of `id` when they give its bounds:
    `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions`."""
    return _read(spark, src, "messages").select(*MESSAGE_COLUMNS)


def read_dim(spark: SparkSession, src: str | dict, table: str) -> DataFrame:
    """Roster, contacts or settings. Spark broadcasts it in joins only below its size threshold."""
    return _read(spark, src, table)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved web pages: page_id, url, html."""
    return spark.read.parquet(path).select("page_id", "url", "html")
