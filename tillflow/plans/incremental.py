"""The batch report kept up to date: only windows that new sales touch are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.operators.windows import EVENT_TIME, assign_windows, slice_of
from tillflow.plans.exact import SLICE_SCHEMA, exact_slices, named_totals, windows_of_slices
from tillflow.schemas import STATISTICS_SCHEMA
from tillflow.settings import WindowSettings
from tillflow.sinks.versions import Versions
from tillflow.sources.master import require_unique_codes

GROUP = ["window_start", "window_end", "item_code"]


class IncrementalReport:
    """Slice sums of all sales so far and the statistics made of them, in one folder.

    Sums are exact, so adding sales in several steps gives the very totals of one run.
    Codes of the master must not repeat: a group is a window and a code, and has the
    names that the code had when new sales last touched it.
    """

    def __init__(self, path: str, windows: WindowSettings = WindowSettings()):
        self.windows = windows
        self.slices = Versions(f"{path}/slices", f"{SLICE_SCHEMA}, day DATE", partitions=("day",))
        self.statistics = Versions(f"{path}/statistics", STATISTICS_SCHEMA)

    def add(self, sales: DataFrame, master: DataFrame, increment: int) -> None:
        """Take in new sales as the increment of that number; a repeated call replaces it."""
        spark = sales.sparkSession
        # One shuffle more keeps a day's sums of an increment in few files.
        slices = exact_slices(sales, self.windows).withColumn("day", F.to_date(EVENT_TIME))
        self.slices.write(slices.repartition("day"), increment)
        report = named_totals(self._touched(spark, increment), require_unique_codes(master))
        self.statistics.write(report, increment)

    def _touched(self, spark: SparkSession, increment: int) -> DataFrame:
        """Exact sums of all windows and items that the increment's slices lie in."""
        new = self.slices.read_version(spark, increment)
        touched = assign_windows(new.select(EVENT_TIME, "item_code"), self.windows).select(*GROUP).distinct()
        tile = F.expr(f"INTERVAL '{slice_of(spark, self.windows)}'")
        times = F.explode(F.sequence("window_start", F.col("window_end") - tile, tile))
        needed = touched.select(times.alias(EVENT_TIME), "item_code").distinct()
        # The days are known before the old slices are planned, so other days are not listed.
        first, last = touched.agg(
            F.min(F.to_date("window_start")), F.max(F.to_date(F.col("window_end") - tile))
        ).first()
        days = F.col("day").between(F.lit(first), F.lit(last)) if first else F.lit(False)
        known = self.slices.read(spark).filter(days)
        sums = windows_of_slices(known.join(needed, [EVENT_TIME, "item_code"], "left_semi"), self.windows)
        return sums.join(touched, GROUP, "left_semi")

    def read(self, spark: SparkSession) -> DataFrame:
        """The report as it stands."""
        return self.statistics.latest(spark, GROUP)

    def compact(self, spark: SparkSession) -> None:
        """Fold the statistics' versions into one; slices stay as they are."""
        self.statistics.compact(spark, GROUP)
