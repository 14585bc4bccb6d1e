"""Settings a caller may change; the defaults give the standard report."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tillflow import schemas


@dataclass(frozen=True)
class WindowSettings:
    """Sliding event-time window and the lateness a stream tolerates."""

    length: str = schemas.WINDOW_LENGTH
    slide: str = schemas.WINDOW_SLIDE
    lateness: str = schemas.ALLOWED_LATENESS


@dataclass(frozen=True)
class JoinSettings:
    """How the item master meets row-level sales.

    ``broadcast`` is the caller's word that the master is small and stays so.
    ``salt`` counts a batch's sales per item and spreads each item that has more
    than ``hot_share`` of them over several tasks. A stream cannot count ahead:
    there ``hot_items`` names such items, with the number of tasks for each.
    """

    broadcast: bool = False
    salt: bool = False
    hot_share: float = 0.01
    hot_items: Mapping[str, int] | None = field(default=None, hash=False)

    def __post_init__(self) -> None:
        if not 0 < self.hot_share <= 1:
            raise ValueError("hot_share must be above 0 and at most 1")
        if any(buckets < 1 for buckets in (self.hot_items or {}).values()):
            raise ValueError("a hot item needs at least 1 bucket")


def use_utc(spark: SparkSession) -> None:
    """Event times carry no zone, so every job reads and prints them as UTC.

    A zone with daylight saving would move times inside its yearly gap.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
