"""Item master from a database."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tillflow.schemas import MASTER_COLUMNS, MASTER_SCHEMA, MASTER_TABLE


FETCH_ROWS = "10000"


@dataclass(frozen=True)
class JdbcTable:
    """Where the master lives. Credentials and driver go into ``properties``.

    A large master is read in parallel either by one ``predicates`` entry per
    task (conditions that together cover each row once), or by ranges of a
    numeric ``column``, for which both bounds and ``num_partitions`` are needed.
    Without either, one task reads the whole table over one connection. Rows
    come ``FETCH_ROWS`` at a time unless ``properties`` say otherwise; some
    drivers would hold a task's whole result in memory.
    """

    url: str
    table: str = MASTER_TABLE
    properties: dict[str, str] = field(default_factory=dict, repr=False)
    predicates: list[str] | None = None
    column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None

    def __post_init__(self) -> None:
        ranges = (self.column, self.lower_bound, self.upper_bound, self.num_partitions)
        if any(r is not None for r in ranges) and any(r is None for r in ranges):
            raise ValueError(
                "reading by ranges needs column, lower_bound, upper_bound and num_partitions"
            )
        if self.column and self.predicates:
            raise ValueError("give either predicates or a column with bounds")


def read_master_jdbc(spark: SparkSession, source: JdbcTable) -> DataFrame:
    """Master rows with all four fields as strings, whatever the table declares.

    On the static side of a stream the table is read again in every
    micro-batch, so new items are seen without a restart.
    """
    properties = {"fetchsize": FETCH_ROWS, **source.properties, "customSchema": MASTER_SCHEMA}
    if source.predicates:
        split = {"predicates": source.predicates}
    elif source.column:
        split = {
            "column": source.column,
            "lowerBound": source.lower_bound,
            "upperBound": source.upper_bound,
            "numPartitions": source.num_partitions,
        }
    else:
        split = {}
    table = spark.read.jdbc(source.url, source.table, properties=properties, **split)
    return table.select(*MASTER_COLUMNS)
