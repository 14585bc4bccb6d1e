"""Sales and master tables as values of the given ``events`` and ``customer``.

Every row of both tables is used. The values are chosen so that each operator
has something to do: unknown items, missing fields on both sides, returns and
dates that do not parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.sources.files import stream_files


# The columns of the given tables that become sales and items.
EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING"
)
CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING"


#: What follows the time of an untidy sale, by its number modulo 8.
UNTIDY = ["", "\n", "\r", "\r\n", " ", "\t", "", ""]


def _sales(events: DataFrame, *more: str) -> DataFrame:
    event_id = F.col("event_id")
    return events.select("*", F.json_tuple("props", "k").alias("k")).select(
        F.when(event_id % 11 == 0, "not-a-date")
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("sales_date"),
        F.date_format("ts", "HH:mm:ss.SSS").alias("sales_time"),
        F.col("user_id").cast("string").alias("item_code"),
        F.col("k").cast("double").alias("sales_quantity"),
        F.col("value").alias("sales_price"),
        F.when(F.col("event_type") == "error", "return").otherwise("sale").alias("sales_return"),
        F.when(event_id % 7 != 0, "N").alias("is_discount"),
        *more,
    )


def sales(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _sales(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"), *more)


def untidy_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sales, most with something more at one end of the date or the time."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 8
    tail = F.element_at(F.array(*map(F.lit, UNTIDY)), (kind + 1).cast("int"))
    sales = _sales(events, "event_id")
    return sales.select(
        F.when(kind == 7, F.concat(F.lit(" "), "sales_date"))
        .otherwise(F.col("sales_date"))
        .alias("sales_date"),
        F.concat("sales_time", tail).alias("sales_time"),
        *sales.columns[2:-1],
    )


def sales_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sales, as a stream fed by the events file."""
    return _sales(
        stream_files(spark, sf_dir, EVENTS_SCHEMA, "parquet", name_glob="events.parquet")
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an item; one code in ten is a code no sale carries.

    Every third name has blanks at both ends.
    """
    customers = spark.read.schema(CUSTOMER_SCHEMA).parquet(f"{sf_dir}/customer.parquet")
    code = F.col("c_custkey").cast("string")
    return customers.select(
        F.when(F.col("c_custkey") % 10 == 9, F.concat(F.lit("old-"), code))
        .otherwise(code)
        .alias("item_code"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit(" ")))
        .otherwise(F.col("c_name"))
        .alias("item_name"),
        F.col("c_nationkey").cast("string").alias("category_code"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("category_name"),
    )
