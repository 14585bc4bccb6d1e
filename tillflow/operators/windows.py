"""Sliding event-time windows, their totals and their order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillflow.schemas import GROUP_COLUMNS, MASTER_COLUMNS, STATISTICS_COLUMNS
from tillflow.settings import WindowSettings

EVENT_TIME = "sales_datetime"

#: Slices are dealt out by their keys and by blocks of window starts. A block is this many
#: window lengths long, so that one slice in so many is copied to a second block.
BLOCK_LENGTHS = 12


def sliding_window(windows: WindowSettings) -> Column:
    """Window struct, ``[start, end)``, aligned to the Unix epoch."""
    return F.window(EVENT_TIME, windows.length, windows.slide)


def durations(spark: SparkSession, windows: WindowSettings) -> tuple[int, int]:
    """Window length and slide in microseconds."""
    lasts = "unix_micros(timestamp_micros(0) + CAST({0} AS INTERVAL))"
    # Over literal values this is folded while planning, and no job runs.
    both = f"SELECT {lasts.format('length')}, {lasts.format('slide')} FROM VALUES (:length, :slide)"
    named = f"{both} AS durations(length, slide)"
    row = spark.sql(named, args={"length": windows.length, "slide": windows.slide}).collect()[0]
    return row[0], row[1]


def slice_of(spark: SparkSession, windows: WindowSettings) -> str:
    """The longest duration that both window length and slide are multiples of.

    Slices of it, aligned to the epoch like the windows, tile every window.
    """
    return f"{math.gcd(*durations(spark, windows))} microseconds"


def assign_windows(sales: DataFrame, windows: WindowSettings = WindowSettings()) -> DataFrame:
    """One row per sale and window it falls in; a null time falls in none."""
    return sales.select("*", sliding_window(windows).alias("window")).select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *sales.columns,
    )


def sums_of_slices(
    slices: DataFrame, keys: list[str], sums: list[str], windows: WindowSettings = WindowSettings()
) -> DataFrame:
    """``sums`` per window and keys, from rows that hold them per slice and keys.

    Nothing is aggregated or shuffled that has been multiplied to windows. A key's
    slices are read in order, and each carries those that follow it within a window's
    length. The first slice of a window makes its row, whole. A task holds the slices
    of one key and block at a time, whatever the number of rows and windows.
    """
    length, slide = durations(slices.sparkSession, windows)
    block = slide * math.ceil(BLOCK_LENGTHS * length / slide)
    # Windows that start in a block reach up to a window's length beyond its end.
    reach = F.window(EVENT_TIME, f"{block + length} microseconds", f"{block} microseconds")
    in_order = Window.partitionBy(*keys, "block").orderBy(F.unix_micros(EVENT_TIME))
    within = in_order.rangeBetween(0, length - math.gcd(length, slide))
    carried = slices.select("*", reach.start.alias("block")).select(
        EVENT_TIME,
        *keys,
        "block",
        F.lag(EVENT_TIME).over(in_order).alias("before"),
        F.collect_list(F.struct(EVENT_TIME, *sums)).over(within).alias("slices"),
    )
    start = F.col("window_start")
    first = (start > F.col("before")) | F.col("before").isNull()
    in_block = (start >= F.col("block")) & (F.unix_micros(start) < F.unix_micros("block") + block)
    kinds = dict(slices.dtypes)
    none = F.struct(*[F.lit(0).cast(kinds[name]).alias(name) for name in sums])

    def added(total: Column, one: Column) -> Column:
        more = F.struct(*[(total[name] + one[name]).alias(name) for name in sums])
        return F.when(one[EVENT_TIME] < F.col("window_end"), more).otherwise(total)

    return (
        assign_windows(carried, windows)
        .filter(first & in_block)
        .select("window_start", "window_end", *keys, F.aggregate("slices", none, added).alias("sums"))
        .select("window_start", "window_end", *keys, "sums.*")
    )


def totals() -> list[Column]:
    """The two sums of the report."""
    return [
        F.sum("sales_amount").alias("total_sales_amount"),
        F.sum("sales_quantity").alias("total_sales_quantity"),
    ]


def window_totals(sales: DataFrame, windows: WindowSettings = WindowSettings()) -> DataFrame:
    """Totals per window and item with its descriptive fields, stream or batch.

    The watermark bounds the state of a stream and is inert in batch.
    """
    return (
        sales.withWatermark(EVENT_TIME, windows.lateness)
        .groupBy(sliding_window(windows).alias("window"), *MASTER_COLUMNS)
        .agg(*totals())
        .withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
        .select(*STATISTICS_COLUMNS)
    )


def order_statistics(statistics: DataFrame) -> DataFrame:
    """Ascending by ``window_start``; batch only, as a stream cannot be sorted.

    The remaining group columns break ties. That makes the order repeatable,
    and lets the range partitioner split one crowded window over many tasks.
    """
    return statistics.orderBy(*GROUP_COLUMNS)
