"""Message bodies: CSV text in, JSON text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.schemas import (
    GROUP_COLUMNS,
    GROUP_SCHEMA,
    SALES_COLUMNS,
    SALES_SCHEMA,
    STATISTICS_COLUMNS,
    STATISTICS_SCHEMA,
)

# The CSV writer strips blanks unless told otherwise; the reader does not.
KEEP_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_JSON = {
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def decode_sales(messages: DataFrame) -> DataFrame:
    """Sales rows from messages whose ``value`` holds one CSV record each.

    Permissive: an unreadable number or a missing trailing field is null, a
    surplus field is ignored, and the row itself is always kept.

    ``inline`` over the one record adds no rows. Unlike a projection of the
    record's fields it is a step that later filters cannot move below, where
    Catalyst would parse the text again for every field they mention.
    """
    record = F.from_csv(F.col("value").cast("string"), SALES_SCHEMA)
    return messages.select(F.inline(F.array(record)))


def encode_sales(sales: DataFrame) -> DataFrame:
    """The inverse of :func:`decode_sales`: one binary ``value`` per sale.

    Blanks at the ends of a field are kept. An empty text comes back as null,
    since the record has nothing between its commas for either.
    """
    record = F.to_csv(F.struct(*SALES_COLUMNS), KEEP_BLANKS)
    return sales.select(record.cast("binary").alias("value"))


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), _JSON)


def encode_statistics(statistics: DataFrame, *more: Column) -> DataFrame:
    """``key`` and ``value`` of each statistics row, both JSON text in UTC, and ``more``.

    The key names the whole group (window, item and its descriptive fields),
    so a consumer can drop the repeats that at-least-once delivery may bring
    without merging the two groups an item has in the window it is renamed in.
    """
    return statistics.select(
        _json(*GROUP_COLUMNS).alias("key"),
        _json(*STATISTICS_COLUMNS).alias("value"),
        *more,
    )


def decode_statistics(messages: DataFrame) -> DataFrame:
    """The inverse of :func:`encode_statistics`, from ``value`` alone."""
    row = F.from_json(F.col("value").cast("string"), STATISTICS_SCHEMA, _JSON)
    return messages.select(row.alias("row")).select("row.*")


def decode_statistics_with_keys(messages: DataFrame) -> DataFrame:
    """As :func:`decode_statistics`, with the fields of the key as ``key_...``."""
    key = F.from_json(F.col("key").cast("string"), GROUP_SCHEMA, _JSON)
    row = F.from_json(F.col("value").cast("string"), STATISTICS_SCHEMA, _JSON)
    return messages.select(key.alias("key"), row.alias("row")).select(
        "row.*", *[F.col(f"key.{c}").alias(f"key_{c}") for c in GROUP_COLUMNS]
    )
