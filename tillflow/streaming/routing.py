"""An account of every message: sales in time, late ones, and those that are none.

Spark drops late rows inside the stateful operator, where nothing but a count of
partial sums is seen of them. Here a stateless stream stands before it, decides by the
same rule and keeps each message under its fate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tillflow.functions.letters import examined_messages
from tillflow.operators.windows import EVENT_TIME
from tillflow.schemas import COMPLETED_SALE, SALES_COLUMNS, SALES_SCHEMA
from tillflow.settings import WindowSettings
from tillflow.sinks.versions import Versions

#: In time for a window at least, too late for all of them, returned, no usable record.
KEPT, LATE, RETURNED, DEAD = "kept", "late", "returned", "dead"
ROUTED_SCHEMA = f"value BINARY, {SALES_SCHEMA}, sales_datetime TIMESTAMP, problem STRING, fate STRING"
ACCOUNT_SCHEMA = (
    "messages BIGINT, kept BIGINT, late BIGINT, returned BIGINT, dead BIGINT, latest BIGINT"
)


def last_window_end(windows: WindowSettings) -> Column:
    """The end of the last window a sale falls in."""
    return F.window(EVENT_TIME, windows.slide)["start"] + F.expr(f"INTERVAL '{windows.length}'")


def with_fate(examined: DataFrame, latest: int | None, windows: WindowSettings) -> DataFrame:
    """Examined messages with their ``fate``, given the ``latest`` time of the batches before.

    That is in microseconds, None at first. The watermark is that time less the
    lateness; a window that ends at or before it has closed.
    """
    before = F.timestamp_micros(F.lit(latest).cast("long"))
    watermark = before - F.expr(f"INTERVAL '{windows.lateness}'")
    # A null time has no window, and its row would be gone.
    timed = F.coalesce(F.col(EVENT_TIME), F.lit(0).cast("timestamp"))
    rows = examined.withColumn("_time", F.col(EVENT_TIME)).withColumn(EVENT_TIME, timed)
    rows = rows.withColumn("_ends", last_window_end(windows)).withColumn(EVENT_TIME, F.col("_time"))
    fate = (
        F.when(F.col("problem").isNotNull(), DEAD)
        .when(F.col("sales_return") != COMPLETED_SALE, RETURNED)
        .when(F.col("_ends") <= watermark, LATE)
        .otherwise(KEPT)
    )
    return rows.withColumn("fate", fate).drop("_time", "_ends")


class Routing:
    """A folder of routed messages and the accounts of their micro-batches."""

    def __init__(self, path: str, windows: WindowSettings = WindowSettings()):
        self.windows = windows
        self.routed = Versions(f"{path}/routed", ROUTED_SCHEMA)
        self.accounts = Versions(f"{path}/accounts", ACCOUNT_SCHEMA)

    def _latest_before(self, spark: SparkSession, batch_id: int) -> int | None:
        """The latest kept time of all batches before; each account carries it on."""
        if batch_id == 0:
            return None
        before = self.accounts.read_version(spark, batch_id - 1).first()
        return before["latest"] if before else None

    def route(self, batch: DataFrame, batch_id: int) -> None:
        """Keep a micro-batch's messages under their fates, and its account.

        Both are versions of the batch's number: a batch that is run again meets the
        same watermark and replaces itself.
        """
        spark = batch.sparkSession
        latest = self._latest_before(spark, batch_id)
        rows = with_fate(examined_messages(batch), latest, self.windows)
        seen = Observation()
        counts = [F.count(F.when(F.col("fate") == f, 1)).alias(f) for f in (KEPT, LATE, RETURNED, DEAD)]
        newest = F.max(F.when(F.col("fate") == KEPT, F.unix_micros(EVENT_TIME))).alias("newest")
        self.routed.write(rows.observe(seen, F.count("*").alias("messages"), *counts, newest), batch_id)
        found = seen.get
        times = [t for t in (latest, found["newest"]) if t is not None]
        account = [*[found[c] for c in ("messages", KEPT, LATE, RETURNED, DEAD)], max(times, default=None)]
        self.accounts.write(spark.createDataFrame([account], ACCOUNT_SCHEMA), batch_id)

    def writer(self, messages: DataFrame, checkpoint: str) -> DataStreamWriter:
        """A configured, not yet started writer of a stream of messages."""
        return messages.writeStream.foreachBatch(self.route).option("checkpointLocation", checkpoint)

    def sales(self, spark: SparkSession, fate: str = KEPT) -> DataFrame:
        """Sales records of one fate."""
        return self.routed.read(spark).filter(F.col("fate") == fate).select(*SALES_COLUMNS)

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        """Messages that are no usable record, and why."""
        return self.routed.read(spark).filter(F.col("fate") == DEAD).select("value", "problem")

    def account(self, spark: SparkSession) -> DataFrame:
        """Counts by fate of each micro-batch; they add up to its ``messages``."""
        return self.accounts.read(spark).withColumnRenamed("version", "batch")
