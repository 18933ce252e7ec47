"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Join sides are broadcast only below Spark's own size threshold, measured at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rank limits up to the largest one used are applied before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10001",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a Python worker holds of its input at once, besides one row of any length.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session; cluster sizing stays with the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def materialized(df: DataFrame) -> DataFrame:
    """Compute a DataFrame once for several readers, in the cluster's checkpoint folder.

    The folder is the one the cluster names in `spark.checkpoint.dir`, so a lost executor loses
    nothing; in a session without any the readers share the plan alone.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            return df
        context.setCheckpointDir(named)
    return df.checkpoint()
