"""Which texts are an event time, and that the cheap path agrees with the pattern."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillflow.functions.event_time import event_time
from tillflow.operators.cleaning import with_event_time
from tillflow.schemas import EVENT_TIME_PATTERN


def parse(spark, pairs):
    df = spark.createDataFrame(pairs, "d STRING, t STRING")
    return [r[0] for r in df.select(event_time(F.col("d"), F.col("t"))).collect()]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_accepted_and_refused_texts(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    good = [("2024-01-01", "10:00:00.123"), ("2024-01-01", "10:00:00.1")]
    bad = [
        ("2024-01-01", "10:00:00.123\n"),
        ("2024-01-01", "10:00:00.123\r"),
        ("2024-01-01", "10:00:00.123\r\n"),
        ("2024-01-01", "10:00:00"),
        ("2024-01-01", "10:00:00.123456"),
        ("2024-1-1", "10:00:00.000"),
        ("2024-02-30", "10:00:00.000"),
        ("2024-01-01", "24:00:00.000"),
        ("bad", "bad"),
        ("2024-01-01", None),
        (None, "10:00:00.000"),
    ]
    found = parse(spark, good + bad)
    assert found[:2] == [
        datetime(2024, 1, 1, 10, 0, 0, 123000),
        datetime(2024, 1, 1, 10, 0, 0, 100000),
    ]
    assert found[2:] == [None] * len(bad)


def odd_texts(n=4000):
    """Well-formed, slightly broken and plainly wrong dates and times."""
    rng = random.Random(7)
    for _ in range(n):
        year = rng.choice([0, 1, 1582, 1900, 1970, 2024, 9999])
        date = f"{year:04d}-{rng.randint(0, 13):02d}-{rng.randint(0, 32):02d}"
        digits = rng.randint(0, 4)
        fraction = "." + "".join(rng.choice("0123456789") for _ in range(digits))
        clock = [rng.randint(0, 25), rng.randint(0, 61), rng.randint(0, 61)]
        time = ":".join(f"{part:02d}" for part in clock) + fraction
        if rng.random() < 0.3:
            text = list(date if rng.random() < 0.5 else time)
            at = rng.randrange(len(text))
            text[at] = rng.choice(["", " ", "+", "-", "Z", "T", "١", "0", "a", "."])
            if rng.random() < 0.5:
                date = "".join(text)
            else:
                time = "".join(text)
        yield (date, time)
    # The pattern allows nothing around it, not even what a cast would trim.
    for odd in ("\n", "\r", "\r\n", " ", "\t", "\n\n", "\x0b", "\u2028", "\u0085"):
        for date, time in (("2024-01-01" + odd, ""), (odd + "2024-01-01", "")):
            yield (date, "10:00:00.123")
        for time in ("10:00:00.123" + odd, odd + "10:00:00.123", "10:00:00" + odd):
            yield ("2024-01-01", time)
    # Hours that daylight saving skips or repeats in two of the zones below.
    for day in ("2024-03-10", "2024-11-03", "2024-03-31", "2024-10-27"):
        for hour in range(4):
            yield (day, f"{hour:02d}:30:00.5")
    yield ("+12024-01-01", "10:00:00.000")
    yield ("-2024-01-01", "10:00:00.000")


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Europe/Berlin", "Asia/Kolkata"])
def test_same_as_the_pattern_alone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    df = spark.createDataFrame(list(odd_texts()), "d STRING, t STRING")
    pattern = F.try_to_timestamp(F.concat("d", F.lit(" "), "t"), F.lit(EVENT_TIME_PATTERN))
    both = df.select("d", "t", event_time(F.col("d"), F.col("t")).alias("ours"), pattern.alias("p"))
    assert both.filter(~F.col("ours").eqNullSafe(F.col("p"))).collect() == []
    assert both.filter("p IS NOT NULL").count() > 500
    assert both.filter("p IS NULL").count() > 500


def test_rows_are_kept_and_date_and_time_replaced(sales):
    timed = with_event_time(sales("2024-01-01,10:00:00.000,A,1,2,sale,Y", "bad,x,A,1,2,sale,Y"))
    assert timed.columns == [
        "item_code",
        "sales_quantity",
        "sales_price",
        "sales_return",
        "is_discount",
        "sales_datetime",
    ]
    assert [r.sales_datetime for r in timed.collect()] == [datetime(2024, 1, 1, 10), None]
