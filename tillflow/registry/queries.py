"""One runnable query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.functions.letters import dead_letters as rejected
from tillflow.functions.letters import examined_messages, usable_records
from tillflow.functions.messages import (
    KEEP_BLANKS,
    decode_sales,
    decode_statistics_with_keys,
    encode_sales,
    encode_statistics,
)
from tillflow.operators import cleaning
from tillflow.operators.windows import assign_windows, order_statistics
from tillflow.plans import statistics as reports
from tillflow.plans.batch_job import run_batch_job
from tillflow.plans.exact import exact_statistics
from tillflow.plans.incremental import IncrementalReport
from tillflow.plans.process import join_sales_and_master, process_item_sales_data
from tillflow.registry import tables
from tillflow.schemas import STATISTICS_SCHEMA
from tillflow.settings import JoinSettings, WindowSettings, use_utc
from tillflow.sinks.files import publish_statistics, read_published, write_statistics
from tillflow.sinks.upserts import read_upserts, upsert_writer
from tillflow.sources.days import write_sales_by_day
from tillflow.sources.files import (
    read_master,
    read_sales,
    read_statistics_csv,
    stream_files,
)
from tillflow.streaming.consumer import statistics_once
from tillflow.streaming.job import rocksdb_state, run_to_end, statistics_stream
from tillflow.streaming.routing import Routing
from tillflow.streaming.state import open_windows
from tillflow.workspace import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _comparable(df: DataFrame, cents: bool = True) -> DataFrame:
    """Timestamps without zone and sums in cents, as the checking SQL has them.

    Plain sums of doubles depend on the order of rows in their last bits; exact ones
    do not, and are left as they are.
    """
    columns = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif cents and name.startswith("total_"):
            column = F.round(column, 2)
        columns.append(column.alias(name))
    return df.select(*columns)


def query(function: Query) -> Query:
    """Register ``function`` under its name, to run in UTC."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return _comparable(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return run


def exact_query(function: Query) -> Query:
    """As :func:`query`, for totals that are compared to the last bit."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        use_utc(spark)
        return _comparable(function(spark, sf_dir), cents=False)

    QUERIES[function.__name__] = run
    return run


@query
def join_sales_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_sales_and_master(tables.sales(spark, sf_dir), tables.master(spark, sf_dir))


@query
def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.with_event_time(tables.sales(spark, sf_dir))


@query
def event_time_untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks and line breaks around date and time, which the pattern refuses."""
    return cleaning.with_event_time(tables.untidy_sales(spark, sf_dir))


@query
def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_sales_master.__wrapped__(spark, sf_dir)
    return cleaning.complete_rows(cleaning.with_event_time(joined))


@query
def completed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.completed_sales(tables.sales(spark, sf_dir))


@query
def sales_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.with_sales_amount(tables.sales(spark, sf_dir))


@query
def process_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_item_sales_data(
        spark, tables.sales(spark, sf_dir), tables.master(spark, sf_dir)
    )


@query
def process_sales_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``process_sales``, with a salt for the items that have many of the sales."""
    return process_item_sales_data(
        spark,
        tables.sales(spark, sf_dir),
        tables.master(spark, sf_dir),
        JoinSettings(salt=True, hot_share=0.001),
    )


@query
def sliding_window_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_windows(cleaning.with_event_time(tables.sales(spark, sf_dir)))


@query
def sales_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sales_statistics(tables.sales(spark, sf_dir), tables.master(spark, sf_dir))


@query
def sales_statistics_long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours every five minutes: each sale counts in 24 windows."""
    return reports.sales_statistics(
        tables.sales(spark, sf_dir),
        tables.master(spark, sf_dir),
        WindowSettings("2 hours", "5 minutes"),
    )


@query
def analyzed_process_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.analyze_item_sales_data_statistics(process_sales.__wrapped__(spark, sf_dir))


@query
def sales_statistics_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_statistics(sales_statistics.__wrapped__(spark, sf_dir))


@query
def decode_csv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_sales(encode_sales(tables.sales(spark, sf_dir)))


def _write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).options(**KEEP_BLANKS).csv(path)
    return path


@query
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv-scan")
    sales = _write_csv(tables.sales(spark, sf_dir), f"{folder}/sales")
    return read_sales(spark, sales, check_header=True)


@query
def csv_scan_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv-scan-master")
    master = _write_csv(tables.master(spark, sf_dir), f"{folder}/master")
    return read_master(spark, master, check_header=True)


@query
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'csv-sink')}/statistics"
    write_statistics(sales_statistics.__wrapped__(spark, sf_dir), path)
    return read_statistics_csv(spark, path)


@query
def batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "batch-job")
    sales = _write_csv(tables.sales(spark, sf_dir), f"{folder}/sales")
    master = _write_csv(tables.master(spark, sf_dir), f"{folder}/master")
    run_batch_job(spark, sales, master, f"{folder}/statistics")
    return read_statistics_csv(spark, f"{folder}/statistics")


@query
def statistics_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = encode_statistics(sales_statistics.__wrapped__(spark, sf_dir))
    return decode_statistics_with_keys(sent)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = encode_sales(tables.sales_stream(spark, sf_dir))
    return statistics_stream(messages, tables.master(spark, sf_dir))


@query
def stream_statistics_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With window state in RocksDB, as the job keeps it."""
    folder = shared_folder(spark, "stream-append")
    with rocksdb_state(spark):
        run_to_end(
            _streamed(spark, sf_dir)
            .writeStream.format("parquet")
            .option("path", f"{folder}/statistics")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append")
        )
    return spark.read.schema(STATISTICS_SCHEMA).parquet(f"{folder}/statistics")


@query
def stream_statistics_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stream-complete")

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/statistics")

    run_to_end(
        _streamed(spark, sf_dir)
        .writeStream.foreachBatch(replace)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("complete")
    )
    return spark.read.schema(STATISTICS_SCHEMA).parquet(f"{folder}/statistics")


@query
def stream_late_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one query; the second brings sales whose windows have closed.

    The first run gets the cheaper sales of the first half of the month, the
    second all others, among them the dearer ones of the first half.
    """
    folder = shared_folder(spark, "stream-late")
    sales, master = tables.sales(spark, sf_dir), tables.master(spark, sf_dir)
    early = (F.col("sales_date") < "2024-01-16") & (F.col("sales_price") < 20)
    for arrived in (early, ~early):
        encode_sales(sales.filter(arrived)).write.mode("append").parquet(f"{folder}/messages")
        messages = stream_files(spark, f"{folder}/messages", "value BINARY", "parquet")
        run_to_end(
            statistics_stream(messages, master)
            .writeStream.format("parquet")
            .option("path", f"{folder}/statistics")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append")
        )
    return spark.read.schema(STATISTICS_SCHEMA).parquet(f"{folder}/statistics")


@query
def stream_statistics_at_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by item code alone; closed windows meet the master."""
    folder = shared_folder(spark, "stream-closing")
    messages = encode_sales(tables.sales_stream(spark, sf_dir))
    statistics = statistics_stream(messages, tables.master(spark, sf_dir), names_at_closing=True)
    with rocksdb_state(spark):
        run_to_end(
            statistics.writeStream.format("parquet")
            .option("path", f"{folder}/statistics")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append")
        )
    return spark.read.schema(STATISTICS_SCHEMA).parquet(f"{folder}/statistics")


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Messages of two runs: the cheaper sales of half a month, then all others.

    With each sale comes the text its quantity was taken from, which is no record.
    """
    early = (F.col("sales_date") < "2024-01-16") & (F.col("sales_price") < 20)
    sales = tables.sales(spark, sf_dir, "props")
    late = F.coalesce(~early, F.lit(True))
    return [
        encode_sales(rows).unionAll(rows.select(F.col("props").cast("binary").alias("value")))
        for rows in (sales.filter(early), sales.filter(late))
    ]


def _routed(spark: SparkSession, sf_dir: str) -> Routing:
    folder = shared_folder(spark, "stream-routing")
    routing = Routing(f"{folder}/out")
    for arrived in _arrivals(spark, sf_dir):
        arrived.write.mode("append").parquet(f"{folder}/messages")
        messages = stream_files(spark, f"{folder}/messages", "value BINARY", "parquet")
        run_to_end(routing.writer(messages, f"{folder}/checkpoint"))
    return routing


@query
def stream_sales_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every message, by micro-batch."""
    account = _routed(spark, sf_dir).account(spark)
    return account.select("batch", "messages", "kept", "late", "returned", "dead")


@query
def stream_late_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late sales themselves."""
    return _routed(spark, sf_dir).sales(spark, "late")


@query
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are no usable record, by what is wrong with them."""
    early, late = _arrivals(spark, sf_dir)
    letters = rejected(examined_messages(early.unionAll(late)))
    return letters.groupBy("problem").agg(F.count("*").alias("n"))


@query
def usable_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other output: every record that is whole."""
    early, late = _arrivals(spark, sf_dir)
    return usable_records(examined_messages(early.unionAll(late)))


@query
def stream_statistics_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode in two runs, so that windows change after they were first written."""
    folder = shared_folder(spark, "stream-upserts")
    sales, master = tables.sales(spark, sf_dir), tables.master(spark, sf_dir)
    cheap = F.col("sales_price") < 20
    for arrived in (sales.filter(cheap), sales.filter(~cheap)):
        encode_sales(arrived).write.mode("append").parquet(f"{folder}/messages")
        messages = stream_files(spark, f"{folder}/messages", "value BINARY", "parquet")
        statistics = statistics_stream(messages, master, WindowSettings(lateness="60 days"))
        run_to_end(upsert_writer(statistics, f"{folder}/versions", f"{folder}/checkpoint", 2))
    return read_upserts(spark, f"{folder}/versions")


@query
def stream_open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was appended and what the state still holds: all windows there are."""
    folder = shared_folder(spark, "stream-state")
    statistics = statistics_stream(
        encode_sales(tables.sales_stream(spark, sf_dir)),
        tables.master(spark, sf_dir),
        WindowSettings(lateness="10 days"),
    )
    run_to_end(
        statistics.writeStream.format("parquet")
        .option("path", f"{folder}/statistics")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
    )
    closed = spark.read.schema(STATISTICS_SCHEMA).parquet(f"{folder}/statistics")
    return closed.withColumn("open", F.lit("no")).unionAll(
        open_windows(spark, f"{folder}/checkpoint").withColumn("open", F.lit("yes"))
    )


@query
def consumed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message delivered twice, the second time in another order."""
    folder = shared_folder(spark, "consumer")
    report = sales_statistics.__wrapped__(spark, sf_dir)
    sent = encode_statistics(report, F.col("window_end").alias("timestamp"))
    sent.write.parquet(f"{folder}/once")
    again = spark.read.parquet(f"{folder}/once")
    schema = "key STRING, value STRING, timestamp TIMESTAMP"
    for order in (F.xxhash64("key"), F.desc("key")):
        again.orderBy(order).write.mode("append").parquet(f"{folder}/messages")
    messages = stream_files(spark, f"{folder}/messages", schema, "parquet", 2)
    run_to_end(
        statistics_once(messages, "60 days")
        .writeStream.format("parquet")
        .option("path", f"{folder}/statistics")
        .option("checkpointLocation", f"{folder}/checkpoint")
    )
    return spark.read.schema(STATISTICS_SCHEMA).parquet(f"{folder}/statistics")


@exact_query
def sales_statistics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals to the last bit, whatever the order of the sales."""
    return exact_statistics(tables.sales(spark, sf_dir), tables.master(spark, sf_dir))


@exact_query
def incremental_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments that share windows; the second reads none of the first's sales."""
    report = IncrementalReport(shared_folder(spark, "incremental"))
    sales, master = tables.sales(spark, sf_dir), tables.master(spark, sf_dir)
    cheap = F.col("sales_price") < 20
    for increment, arrived in enumerate((sales.filter(cheap), sales.filter(~cheap))):
        report.add(arrived, master, increment)
    return report.read(spark)


@query
def published_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version over a first one with less in it."""
    path = f"{shared_folder(spark, 'published')}/statistics"
    master = tables.master(spark, sf_dir)
    sales = tables.sales(spark, sf_dir)
    publish_statistics(reports.sales_statistics(sales.filter("sales_price < 20"), master), path)
    publish_statistics(reports.sales_statistics(sales, master), path)
    return read_published(spark, path)


@query
def statistics_of_two_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows within two days, from sales laid out by day."""
    path = f"{shared_folder(spark, 'by-day')}/sales"
    write_sales_by_day(tables.sales(spark, sf_dir), path)
    span = datetime(2024, 1, 10), datetime(2024, 1, 12)
    return reports.statistics_between(spark, path, tables.master(spark, sf_dir), *span)
