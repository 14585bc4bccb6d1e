"""Report plans: processed or raw sales to totals per item and window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.operators.cleaning import countable_sales, usable_master, with_sales_amount
from tillflow.operators.windows import (
    EVENT_TIME,
    assign_windows,
    durations,
    slice_of,
    sliding_window,
    sums_of_slices,
    totals,
    window_totals,
)
from tillflow.schemas import MASTER_COLUMNS, STATISTICS_COLUMNS
from tillflow.settings import WindowSettings
from tillflow.sources.days import read_sales_between


TOTALS = ["total_sales_amount", "total_sales_quantity"]

#: Up to so many windows a sale, multiplying the sales is cheaper than a second
#: aggregation, which reduces little where an item sells rarely.
MOST_WINDOWS_UNSLICED = 2


def analyze_item_sales_data_statistics(
    processed_sales_data_df: DataFrame, windows: WindowSettings = WindowSettings()
) -> DataFrame:
    """Totals of processed sales, on a stream as well as in batch.

    Unsorted, because a stream cannot be sorted; batch callers add
    ``order_statistics``.
    """
    return window_totals(processed_sales_data_df, windows)


def slice_sums(sales: DataFrame, windows: WindowSettings) -> DataFrame:
    """Totals per slice and item, at the slice's start."""
    tile = F.window(EVENT_TIME, slice_of(sales.sparkSession, windows))
    slices = sales.groupBy(tile.alias("slice"), "item_code").agg(*totals())
    return slices.select(F.col("slice.start").alias(EVENT_TIME), "item_code", *TOTALS)


def sales_statistics(
    item_sales_data_df: DataFrame,
    item_master_data_df: DataFrame,
    windows: WindowSettings = WindowSettings(),
    unique_master: bool = False,
) -> DataFrame:
    """Batch report straight from raw sales: aggregate first, enrich afterwards.

    Equal to processing and then analysing, which joins every sale. Here the
    sales are shuffled once, as partial sums, so an item with a third of all
    sales arrives as a few rows per map task. Where a sale lies in more than
    ``MOST_WINDOWS_UNSLICED`` windows, the sums are per slice first: slices tile
    every window. Then the slices meet the master, and the windows are made from the
    enriched slices, last of all, as there are many times more of them.
    What meets the master is one row per item and window, or slice, whatever the
    item's sales, so a sort-merge join is not skewed either, and the choice between
    that and a broadcast is left to Catalyst and adaptive execution, which know the
    sizes.

    Equal master rows are counted once with their number of copies, since a
    master row listed twice counts its sales twice. ``unique_master`` is the
    caller's word that no code repeats, and spares that.
    """
    if item_sales_data_df.isStreaming:
        raise ValueError("a stream is processed first and then analysed")
    sales = with_sales_amount(countable_sales(item_sales_data_df))
    narrow = sales.select(EVENT_TIME, "item_code", "sales_amount", "sales_quantity")
    length, slide = durations(sales.sparkSession, windows)
    usable = usable_master(item_master_data_df)
    if length > MOST_WINDOWS_UNSLICED * slide:
        slices = with_master(slice_sums(narrow, windows), usable, unique_master)
        return sums_of_slices(slices, MASTER_COLUMNS, TOTALS, windows).select(*STATISTICS_COLUMNS)
    per_item = (
        assign_windows(narrow, windows)
        .groupBy("window_start", "window_end", "item_code")
        .agg(*totals())
    )
    return enriched(per_item, usable, unique_master)


def statistics_at_closing(
    item_sales_data_df: DataFrame,
    item_master_data_df: DataFrame,
    windows: WindowSettings = WindowSettings(),
    unique_master: bool = False,
) -> DataFrame:
    """Totals per item on a stream, enriched when their window closes (append mode).

    The state is keyed by window and item code alone and the sales meet no master:
    they are shuffled as partial sums, so an item with a third of them is a few rows
    per map task, and the join sees one row per closed window and item. A window
    carries the names its item has at closing time; one whose item is not in the
    master by then is left out. The watermark follows all countable sales, those of
    unknown items included.
    """
    sales = with_sales_amount(countable_sales(item_sales_data_df))
    per_item = (
        sales.withWatermark(EVENT_TIME, windows.lateness)
        .groupBy(sliding_window(windows).alias("window"), "item_code")
        .agg(*totals())
        .withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
        .drop("window")
    )
    # The hint keeps a master that grows under a running query from being broadcast.
    return enriched(per_item, usable_master(item_master_data_df).hint("merge"), unique_master)


def with_master(sums: DataFrame, usable: DataFrame, unique_master: bool) -> DataFrame:
    """Totals by item code with the master's fields, times the copies of its row."""
    if unique_master:
        return sums.join(usable, "item_code")
    master = usable.groupBy(*MASTER_COLUMNS).agg(F.count("*").alias("copies"))
    counted = sums.join(master, "item_code")
    return counted.withColumns({t: F.col(t) * F.col("copies") for t in TOTALS}).drop("copies")


def enriched(per_item: DataFrame, usable: DataFrame, unique_master: bool) -> DataFrame:
    """Statistics rows from totals per window and item code."""
    return with_master(per_item, usable, unique_master).select(*STATISTICS_COLUMNS)


def statistics_between(
    spark: SparkSession,
    sales_path: str,
    master: DataFrame,
    start: datetime,
    end: datetime,
    windows: WindowSettings = WindowSettings(),
    unique_master: bool = False,
) -> DataFrame:
    """The report's windows within ``[start, end]``, from sales laid out by day.

    Only the folders of days that the span touches are read. Windows that reach beyond
    the span are left out, as they would be short. Times are UTC, like the sales'.
    """
    sales = read_sales_between(spark, sales_path, start, end)
    report = sales_statistics(sales, master, windows, unique_master)
    inside = (F.col("window_start") >= F.lit(start.isoformat(" ")).cast("timestamp")) & (
        F.col("window_end") <= F.lit(end.isoformat(" ")).cast("timestamp")
    )
    return report.filter(inside)
