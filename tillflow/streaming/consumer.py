"""The other end of the topic: statistics messages, each counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.messages import decode_statistics

#: When a message was published; Kafka's name for it.
PUBLISHED = "timestamp"


def statistics_once(messages: DataFrame, within: str) -> DataFrame:
    """Statistics rows from ``key``, ``value`` and ``timestamp`` of a stream of messages.

    Delivery is at least once and not in order. Of messages with one key the first to
    arrive counts, and the key is remembered for ``within`` after the time it was
    published. A first delivery that comes later than that behind others is lost, so
    ``within`` has to cover the delay of both repeats and stragglers; it bounds the state.
    """
    timed = messages.select(F.col("key").cast("string").alias("key"), "value", PUBLISHED)
    once = timed.withWatermark(PUBLISHED, within).dropDuplicatesWithinWatermark(["key"])
    return decode_statistics(once)
