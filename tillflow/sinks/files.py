"""Statistics to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillflow.functions.messages import KEEP_BLANKS
from tillflow.operators.windows import order_statistics
from tillflow.schemas import GROUP_COLUMNS, STATISTICS_SCHEMA
from tillflow.sinks.versions import WHOLE, Versions


def write_statistics(
    statistics: DataFrame, path: str, files: int | None = None, fmt: str = "csv"
) -> None:
    """Replace the folder ``path`` by sorted files, CSV with a header line by default.

    In CSV, blanks at the ends of a text are kept; line breaks stand in quotes,
    so a reader has to allow records of several lines. An empty text cannot be
    told from a missing one and comes back as null. A columnar ``fmt`` such as
    parquet or ORC keeps all of these.

    By default Spark decides the number of files from the data. ``files`` asks
    for a number: the rows are range-partitioned into that many, so only the
    sort and the write run in that many tasks, and the aggregation before them
    keeps its own parallelism. ``files=1`` gives the single file a small
    report may want; one task then writes everything.
    """
    if files is None:
        ordered = order_statistics(statistics)
    else:
        ordered = statistics.repartitionByRange(files, *GROUP_COLUMNS).sortWithinPartitions(
            *GROUP_COLUMNS
        )
    writer = ordered.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).options(**KEEP_BLANKS).csv(path)
    else:
        writer.format(fmt).save(path)


def published_versions(path: str, fmt: str = "csv") -> Versions:
    options = {"header": "true", "multiLine": "true", **KEEP_BLANKS} if fmt == "csv" else {}
    return Versions(path, STATISTICS_SCHEMA, fmt, tuple(options.items()))


def publish_statistics(statistics: DataFrame, path: str, fmt: str = "csv") -> int:
    """Add sorted files as the next version of the report at ``path``; its number.

    Readers go on seeing the version before until the new one stands as a whole. A job
    that fails in the write leaves it readable, and the next one writes over the remains.
    """
    versions = published_versions(path, fmt)
    version = versions.next_version(statistics.sparkSession)
    versions.write(order_statistics(statistics), version, WHOLE)
    return version


def read_published(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The last report that was published at ``path``."""
    return published_versions(path, fmt).read_last(spark).drop("version")
