"""Messages that are no sales records, told apart instead of lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.functions.event_time import event_time
from tillflow.functions.presence import all_present
from tillflow.schemas import SALES_COLUMNS, SALES_SCHEMA

_CORRUPT = "_corrupt"

#: Why a message is no usable record.
UNREADABLE, UNTIMED, INCOMPLETE = "unreadable record", "unreadable time", "missing field"


def examined_messages(messages: DataFrame) -> DataFrame:
    """``value``, the record's fields, ``sales_datetime`` and ``problem`` of every message.

    ``problem`` is null where every field is there and the time parses, also if the
    sale was returned. A record the parser complains about (a surplus field, say) is
    usable if nothing is missing from it, as it is to ``decode_sales``.
    """
    text = F.col("value").cast("string")
    record = F.from_csv(
        text, f"{SALES_SCHEMA}, {_CORRUPT} STRING", {"columnNameOfCorruptRecord": _CORRUPT}
    )
    fields = messages.select("value", F.inline(F.array(record)))
    parsed = F.explode(F.array(event_time(F.col("sales_date"), F.col("sales_time"))))
    rows = fields.select("*", parsed.alias("sales_datetime"))
    corrupt = F.col(_CORRUPT).isNotNull() | F.coalesce(F.trim(text) == "", F.lit(True))
    missing = ~all_present(rows, SALES_COLUMNS)
    problem = (
        F.when(missing & corrupt, UNREADABLE)
        .when(missing, INCOMPLETE)
        .when(F.col("sales_datetime").isNull(), UNTIMED)
    )
    return rows.withColumn("problem", problem).drop(_CORRUPT)


def usable_records(examined: DataFrame) -> DataFrame:
    """The sales records among examined messages, as ``decode_sales`` gives them."""
    return examined.filter("problem IS NULL").select(*SALES_COLUMNS)


def dead_letters(examined: DataFrame) -> DataFrame:
    """``value`` and ``problem`` of all other messages."""
    return examined.filter("problem IS NOT NULL").select("value", "problem")
