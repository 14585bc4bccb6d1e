"""Command line for the two jobs; the session comes from ``spark-submit``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from tillflow import schemas
from tillflow.plans.batch_job import run_batch_job
from tillflow.settings import JoinSettings, WindowSettings
from tillflow.sinks.kafka import KafkaSink
from tillflow.sources.jdbc import JdbcTable
from tillflow.sources.kafka import KafkaSource
from tillflow.streaming.job import start_statistics_job


def _json_file(path: str) -> dict[str, str] | list[str]:
    return json.loads(Path(path).read_text())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tillflow", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--length", default=schemas.WINDOW_LENGTH, help="window length")
    shared.add_argument("--slide", default=schemas.WINDOW_SLIDE, help="window slide")
    shared.add_argument("--lateness", default=schemas.ALLOWED_LATENESS, help="stream only")
    shared.add_argument(
        "--allow-duplicates", action="store_true", help="accept a master that repeats codes"
    )

    batch = jobs.add_parser("batch", parents=[shared], help="files to files")
    batch.add_argument("--sales", required=True)
    batch.add_argument("--master", required=True)
    batch.add_argument("--output", required=True)
    batch.add_argument("--format", default="csv", help="of the input: csv, parquet, orc")
    batch.add_argument("--check-header", action="store_true")
    batch.add_argument("--output-format", default="csv", help="csv, parquet, orc")
    batch.add_argument("--files", type=int, help="number of output files")
    batch.add_argument(
        "--versioned", action="store_true", help="keep the old report until the new one stands"
    )

    stream = jobs.add_parser("stream", parents=[shared], help="Kafka to Kafka")
    stream.add_argument("--servers", required=True)
    stream.add_argument("--sales-topic", default=schemas.SALES_TOPIC)
    stream.add_argument("--statistics-topic", default=schemas.STATISTICS_TOPIC)
    stream.add_argument("--starting-offsets")
    stream.add_argument("--max-offsets-per-trigger", type=int)
    stream.add_argument("--min-partitions", type=int)
    stream.add_argument("--source-options", type=_json_file, default={}, help="JSON file")
    stream.add_argument("--sink-options", type=_json_file, default={}, help="JSON file")
    stream.add_argument("--jdbc-url", required=True)
    stream.add_argument("--jdbc-table", default=schemas.MASTER_TABLE)
    stream.add_argument(
        "--jdbc-properties", type=_json_file, default={}, help="JSON file: user, password, driver"
    )
    stream.add_argument("--jdbc-predicates", type=_json_file, help="JSON file: one per task")
    stream.add_argument("--jdbc-column", help="numeric, to read in ranges")
    stream.add_argument("--jdbc-lower-bound", type=int)
    stream.add_argument("--jdbc-upper-bound", type=int)
    stream.add_argument("--jdbc-partitions", type=int)
    stream.add_argument(
        "--broadcast-master", action="store_true", help="only if it is small and stays so"
    )
    stream.add_argument("--hot-items", type=_json_file, help="JSON file: tasks by item code")
    stream.add_argument(
        "--names-at-closing", action="store_true", help="aggregate before the master is joined"
    )
    stream.add_argument("--checkpoint", required=True, help="durable shared folder")
    stream.add_argument("--processing-time", help="trigger interval, such as '1 minute'")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"tillflow-{args.job}").getOrCreate()
    windows = WindowSettings(args.length, args.slide, args.lateness)
    if args.job == "batch":
        run_batch_job(
            spark,
            args.sales,
            args.master,
            args.output,
            fmt=args.format,
            check_header=args.check_header,
            unique_master=not args.allow_duplicates,
            files=args.files,
            output_fmt=args.output_format,
            windows=windows,
            versioned=args.versioned,
        )
        return
    query = start_statistics_job(
        spark,
        KafkaSource(
            args.servers,
            args.sales_topic,
            starting_offsets=args.starting_offsets,
            max_offsets_per_trigger=args.max_offsets_per_trigger,
            min_partitions=args.min_partitions,
            options=args.source_options,
        ),
        JdbcTable(
            args.jdbc_url,
            args.jdbc_table,
            args.jdbc_properties,
            predicates=args.jdbc_predicates,
            column=args.jdbc_column,
            lower_bound=args.jdbc_lower_bound,
            upper_bound=args.jdbc_upper_bound,
            num_partitions=args.jdbc_partitions,
        ),
        KafkaSink(args.servers, args.statistics_topic, args.sink_options),
        args.checkpoint,
        unique_master=not args.allow_duplicates,
        trigger={"processingTime": args.processing_time} if args.processing_time else None,
        windows=windows,
        join=JoinSettings(broadcast=args.broadcast_master, hot_items=args.hot_items),
        **({"names_at_closing": True} if args.names_at_closing else {}),
    )
    query.awaitTermination()
