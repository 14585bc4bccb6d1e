"""Statistics in update mode: changed windows replace what was known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tillflow.schemas import GROUP_COLUMNS, STATISTICS_SCHEMA
from tillflow.sinks.versions import Versions


def statistics_versions(path: str) -> Versions:
    return Versions(path, STATISTICS_SCHEMA)


def upsert_writer(
    statistics: DataFrame, path: str, checkpoint: str, compact_every: int = 100
) -> DataStreamWriter:
    """A configured, not yet started update-mode writer to a folder of versions.

    Each micro-batch is the version of its own number with the windows it changed, so
    one that is run again after a failure replaces itself. Every ``compact_every``
    batches the versions are folded into one.
    """
    versions = statistics_versions(path)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        versions.write(batch, batch_id)
        if (batch_id + 1) % compact_every == 0:
            versions.compact(batch.sparkSession, GROUP_COLUMNS)

    return (
        statistics.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
    )


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The statistics as they stand: for each group its last version."""
    return statistics_versions(path).latest(spark, GROUP_COLUMNS)
