"""Event time from the date and time text of a sale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillflow.schemas import EVENT_TIME_PATTERN

# Text of this shape means the same to a cast as to the pattern, and the cast
# is several times cheaper. Everything else is left to the pattern, a line break
# at the end (which ``$`` would pass) included.
_PLAIN_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,3}\z"


def event_time(date: Column, time: Column) -> Column:
    """Timestamp of ``date`` and ``time`` text, null where it does not parse.

    A bad value never fails the job, with or without ANSI mode: such a sale is
    incomplete and is dropped with the other incomplete rows.
    """
    text = F.concat(date, F.lit(" "), time)
    return F.when(text.rlike(_PLAIN_SHAPE), text.try_cast("timestamp")).otherwise(
        F.try_to_timestamp(text, F.lit(EVENT_TIME_PATTERN))
    )
