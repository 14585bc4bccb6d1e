"""Times the report's plans on many copies of the given sales, one item hot.

Spark derives the input from the given tables: every sale ``BENCH_COPIES``
times (200 by default), with every third row moved to one item, spread over
files at random. Prints one line of JSON. ``large_master`` stands for a master
that may not be broadcast.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bench import CPUS, SF_DIR, session
from tillflow import (
    JoinSettings,
    analyze_item_sales_data_statistics,
    process_item_sales_data,
    sales_statistics,
)
from tillflow.operators.cleaning import countable_sales, usable_master, with_sales_amount
from tillflow.registry import tables
from tillflow.workspace import shared_folder

COPIES = int(os.environ.get("BENCH_COPIES", 200))
RUNS = int(os.environ.get("BENCH_RUNS", 3))
HOT_ITEM = "1"


def hot_sales(spark: SparkSession) -> DataFrame:
    path = shared_folder(spark, "scale") + "/sales"
    copies = F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy")
    (
        tables.sales(spark, SF_DIR)
        .repartition(4 * CPUS)
        .select("*", copies)
        .withColumn(
            "item_code", F.when(F.col("copy") % 3 == 0, HOT_ITEM).otherwise(F.col("item_code"))
        )
        .drop("copy")
        .write.parquet(path)
    )
    return spark.read.parquet(path)


def joined_unsalted(sales: DataFrame, master: DataFrame) -> DataFrame:
    """For comparison: the join without hint or salt."""
    joined = countable_sales(sales).join(usable_master(master), "item_code")
    return analyze_item_sales_data_statistics(with_sales_amount(joined))


def main() -> None:
    spark = session()
    spark.conf.set("spark.sql.shuffle.partitions", str(8 * CPUS))
    sales, master = hot_sales(spark), tables.master(spark, SF_DIR)

    def composed(join: JoinSettings) -> DataFrame:
        return analyze_item_sales_data_statistics(
            process_item_sales_data(spark, sales, master, join)
        )

    plans = {
        "small_master.aggregate_first": ("10MB", lambda: sales_statistics(sales, master)),
        "small_master.join_first": ("10MB", lambda: composed(JoinSettings())),
        "large_master.aggregate_first": ("-1", lambda: sales_statistics(sales, master)),
        "large_master.join_first_salted": ("-1", lambda: composed(JoinSettings(salt=True))),
        "large_master.join_first_unsalted": ("-1", lambda: joined_unsalted(sales, master)),
    }
    seconds = {}
    for name, (threshold, plan) in plans.items():
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        runs = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            plan().write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - begin, 2))
        seconds[name] = min(runs)
    print(json.dumps({"rows": sales.count(), "unit": "sec", "cpus": CPUS, "plans": seconds}))


if __name__ == "__main__":
    main()
