"""Windows that a stopped or running stream still holds open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.operators.cleaning import usable_master
from tillflow.plans.statistics import enriched
from tillflow.schemas import STATISTICS_COLUMNS


def open_windows(
    spark: SparkSession, checkpoint: str, master: DataFrame | None = None, unique_master: bool = False
) -> DataFrame:
    """Statistics of the open windows, read from a statistics stream's state.

    The state is that of the last committed micro-batch. With what an append-mode
    sink has received it is the report of all sales that were not late. The state of a
    stream that names items at closing knows codes alone; ``master`` names them now.
    """
    state = spark.read.format("statestore").load(checkpoint)
    # Both sums have the same name in the state; they stand in the order of the totals.
    sums = F.col("value").cast("struct<total_sales_amount: double, total_sales_quantity: double>")
    rows = state.select("key.*", sums.alias("sums")).select("*", "sums.*")
    rows = rows.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
    if master is not None:
        return enriched(rows.drop("window", "sums"), usable_master(master), unique_master)
    return rows.select(*STATISTICS_COLUMNS)
