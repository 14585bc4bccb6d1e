"""Streaming job: CSV messages in, closed windows out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tillflow.functions.messages import decode_sales
from tillflow.plans.process import process_item_sales_data
from tillflow.plans.statistics import analyze_item_sales_data_statistics, statistics_at_closing
from tillflow.settings import JoinSettings, WindowSettings, use_utc
from tillflow.sinks.kafka import KafkaSink, statistics_writer
from tillflow.sources.jdbc import JdbcTable, read_master_jdbc
from tillflow.sources.kafka import KafkaSource, stream_sales_messages
from tillflow.sources.master import require_unique_codes

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep window state in RocksDB, with changelog checkpoints.

    Open groups number about (length + lateness) / slide per active item. For
    a large catalogue that is more than executor heaps should hold, and a
    changelog uploads what a micro-batch changed instead of whole snapshots.
    """
    for name, value in _ROCKSDB.items():
        spark.conf.set(name, value)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """:func:`use_rocksdb_state` for the queries started within, then as before."""
    before = {name: spark.conf.get(name, None) for name in _ROCKSDB}
    use_rocksdb_state(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def statistics_stream(
    messages: DataFrame,
    master: DataFrame,
    windows: WindowSettings = WindowSettings(),
    join: JoinSettings = JoinSettings(),
    names_at_closing: bool = False,
) -> DataFrame:
    """Statistics from messages and a static master; also valid in batch.

    The join stays in front of the aggregation here, unlike in the batch
    report: a sale belongs to the name its item has when it arrives. The join
    does not depend on the master's size, which may change between batches.
    With ``names_at_closing`` the aggregation comes first and a window takes the
    names its item has when it closes; hot items then need no settings.
    """
    sales = decode_sales(messages)
    if names_at_closing:
        return statistics_at_closing(sales, master, windows)
    processed = process_item_sales_data(messages.sparkSession, sales, master, join)
    return analyze_item_sales_data_statistics(processed, windows)


def run_to_end(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is available now, close the windows that may close, stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def start_statistics_job(
    spark: SparkSession,
    source: KafkaSource,
    master: JdbcTable,
    sink: KafkaSink,
    checkpoint: str,
    *,
    unique_master: bool = True,
    rocksdb: bool = True,
    trigger: dict | None = None,
    windows: WindowSettings = WindowSettings(),
    join: JoinSettings = JoinSettings(),
    names_at_closing: bool = False,
) -> StreamingQuery:
    """Start Kafka to Kafka with a JDBC master; the caller owns the query.

    The master is checked for repeated codes at the start, not again later: a
    code repeated from then on counts its sales again.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes, for instance
    ``{"processingTime": "1 minute"}``; Spark's default otherwise.
    """
    use_utc(spark)
    if rocksdb:
        use_rocksdb_state(spark)
    master_table = read_master_jdbc(spark, master)
    if unique_master:
        require_unique_codes(master_table)
    messages = stream_sales_messages(spark, source)
    statistics = statistics_stream(messages, master_table, windows, join, names_at_closing)
    writer = statistics_writer(statistics, sink, checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
