"""Sales meet the item master."""

import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from tillflow.operators.cleaning import (
    completed_sales,
    countable_sales,
    with_event_time,
    with_sales_amount,
)
from tillflow.operators.joins import copied_master, hot_items, join_master, salt_of
from tillflow.plans.process import join_sales_and_master, process_item_sales_data
from tillflow.plans.statistics import analyze_item_sales_data_statistics, sales_statistics
from tillflow.schemas import JOINED_COLUMNS, MASTER_COLUMNS, PROCESSED_COLUMNS
from tillflow.settings import JoinSettings, WindowSettings
from tillflow.sources.master import duplicate_codes, require_unique_codes
from util import cents, plan, rows

SALTED = JoinSettings(salt=True, hot_share=0.05)


def sale(code, quantity=1.0):
    return ("2024-01-01", "10:00:00.000", code, quantity, 2.0, "sale", "Y")


@pytest.fixture
def many_sales(spark):
    """A third of all rows is one item, and most of those are copies of one sale."""
    return spark.range(3000).select(
        F.lit("2024-01-01").alias("sales_date"),
        F.lit("10:00:00.000").alias("sales_time"),
        F.when(F.col("id") % 3 == 0, "A").otherwise((F.col("id") % 7).cast("string")).alias(
            "item_code"
        ),
        F.lit(1.0).alias("sales_quantity"),
        F.lit(2.0).alias("sales_price"),
        F.lit("sale").alias("sales_return"),
        F.lit("Y").alias("is_discount"),
    )


def test_unknown_and_null_codes_vanish_and_columns_are_ordered(table, small_master):
    joined = join_sales_and_master(
        table("sales", sale("A"), sale("Z"), sale(None), sale("C")), small_master
    )
    assert joined.columns == JOINED_COLUMNS
    assert sorted(r.item_code for r in joined.collect()) == ["A", "C"]


def test_null_code_in_both_tables_does_not_match(table):
    master = table("master", (None, "Nothing", "N", "None"))
    assert join_sales_and_master(table("sales", sale(None)), master).count() == 0


@pytest.mark.parametrize("join", [JoinSettings(broadcast=True), SALTED])
def test_a_repeated_code_multiplies_sales(table, join):
    master = table("master", ("A", "Apple", "F", "Fruit"), ("A", "Pear", "F", "Fruit"))
    joined = join_sales_and_master(table("sales", sale("A"), sale("A")), master, join)
    assert sorted(r.item_name for r in joined.collect()) == ["Apple", "Apple", "Pear", "Pear"]


def test_settings_that_cannot_be(table):
    with pytest.raises(ValueError, match="hot_share"):
        JoinSettings(hot_share=0)
    with pytest.raises(ValueError, match="at least 1"):
        JoinSettings(hot_items={"A": 0})


@pytest.mark.parametrize(
    "join",
    [SALTED, JoinSettings(salt=True, hot_share=1.0), JoinSettings(hot_items={"A": 5, "Q": 9})],
)
def test_salted_join_gives_the_same_rows(table, many_sales, join):
    master = table("master", *[(c, f"item {c}", "F", "Fruit") for c in "A12345"])
    given = many_sales.union(table("sales", sale(None), sale("unknown")))
    broadcast = join_sales_and_master(given, master, JoinSettings(broadcast=True))
    salted = join_sales_and_master(given, master, join)
    assert rows(salted) == rows(broadcast)
    assert salted.columns == broadcast.columns


def test_buckets_follow_the_share(spark, many_sales, table):
    """A has a third of 3000 sales; the other seven codes have 286 or 285 each."""
    hot = hot_items(many_sales, JoinSettings(salt=True, hot_share=0.1))
    assert rows(hot) == [("A", 4)]
    finer = dict(rows(hot_items(many_sales, JoinSettings(salt=True, hot_share=0.02))))
    assert finer["A"] == 17 and set(finer.values()) == {17, 5} and len(finer) == 8
    assert hot_items(many_sales.limit(0), SALTED).count() == 0
    nulls = table("sales", *[sale(None)] * 5, sale("A"))
    assert rows(hot_items(nulls, JoinSettings(salt=True, hot_share=0.1))) == [("A", 2)]


def test_cold_master_rows_are_copied_once(spark, many_sales, table):
    master = table(
        "master", ("A", "Apple", "F", "Fruit"), *[(f"c{i}", "x", "F", "Fruit") for i in range(500)]
    )
    copies = copied_master(master, hot_items(many_sales, JoinSettings(salt=True, hot_share=0.1)))
    assert copies.count() == 500 + 4
    assert copies.filter("item_code = 'A'").count() == 4
    assert {r.salt for r in copies.filter("item_code <> 'A'").collect()} == {0}


def test_no_salt_is_counted_for_unless_asked(spark, many_sales, small_master):
    text = plan(join_sales_and_master(many_sales, small_master))
    assert "Aggregate" not in text


def test_salt_spreads_copies_of_one_sale(spark, table, many_sales):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    master = table("master", ("A", "Apple", "F", "Fruit"))
    # Only one distinct sale remains, read by 16 tasks.
    hot = many_sales.filter("item_code = 'A'").coalesce(8).union(
        many_sales.filter("item_code = 'A'").coalesce(8)
    )
    joined = join_master(hot, master, JoinSettings(hot_items={"A": 64}))
    sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 2000
    assert len(sizes) >= 4


def test_a_rerun_gives_each_sale_the_same_salt(spark, many_sales, tmp_path):
    """A lost task is computed again; its rows must go where they went before."""
    many_sales.repartition(4).write.parquet(str(tmp_path / "sales"))
    stored = spark.read.parquet(str(tmp_path / "sales"))
    where = stored.select(
        F.spark_partition_id().alias("part"), salt_of(stored, F.lit(8)), salt_of(stored, F.lit(None))
        .alias("cold")
    )
    first, again = (rows(where.groupBy("part", "salt", "cold").count()) for _ in range(2))
    assert first == again
    assert {r[1] for r in first} <= set(range(8)) and len({r[1] for r in first}) > 4
    assert {r[2] for r in first} == {0}


def test_catalyst_chooses_the_join_of_a_batch(spark, table, many_sales, tmp_path):
    table("master", *[(c, f"item {c}", "F", "Fruit") for c in "A12345"]).write.parquet(
        str(tmp_path / "master")
    )
    master = spark.read.parquet(str(tmp_path / "master"))
    assert "BroadcastHashJoin" in plan(join_master(many_sales, master))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    large = plan(join_master(many_sales, master))
    assert "SortMergeJoin" in large and "Broadcast" not in large


def test_planning_runs_no_job(spark, many_sales, small_master):
    spark.sparkContext.setJobGroup("planning", "planning")
    for join in (JoinSettings(), SALTED, JoinSettings(hot_items={"A": 3})):
        process_item_sales_data(spark, many_sales, small_master, join)
    sales_statistics(many_sales, small_master)
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup(None, None)
    assert list(ran) == []


def test_processed_rows(spark, sales, small_master):
    processed = process_item_sales_data(
        spark,
        sales(
            "2024-01-01,10:00:00.000,A,1,2,sale,Y",
            "2024-01-01,10:07:00.000,A,3,2,sale,N",
            "2024-01-01,10:07:00.000,B,1,1,return,N",
            "2024-01-01,10:07:00.000,Z,1,1,sale,N",
            "2024-01-01,10:07:00.000,C,1,1,sale,N",
            "2024-01-01,10:07:00.000,B,1,1,sale,",
            "2024-01-01,10:07:00,B,1,1,sale,N",
            "2024-01-01,10:07:00.000,B,NaN,1,sale,N",
        ),
        small_master,
    )
    assert processed.columns == PROCESSED_COLUMNS
    assert dict(processed.dtypes)["sales_datetime"] == "timestamp"
    found = [(r.item_name, r.sales_quantity, r.sales_amount) for r in processed.collect()]
    assert sorted(found) == [("Apple", 1.0, 2.0), ("Apple", 3.0, 6.0)]


def test_processing_equals_checking_the_joined_row(spark, table, small_master):
    """Checks before the join keep the rows that checks after it would."""
    given = table(
        "sales",
        *product(
            ["2024-01-01", "bad", None],
            ["10:00:00.000", None],
            ["A", "B", "C", "Z", None],
            [1.0, math.nan, None],
            [2.0, None],
            ["sale", "return", None],
            ["Y", None],
        ),
    )
    late = with_event_time(join_sales_and_master(given, small_master)).dropna()
    late = with_sales_amount(completed_sales(late)).select(*PROCESSED_COLUMNS)
    early = process_item_sales_data(spark, given, small_master)
    assert rows(early) == rows(late)
    assert early.count() == 2


def test_duplicate_codes(table, small_master):
    assert require_unique_codes(small_master) is small_master
    twice = small_master.union(small_master.filter("item_code = 'A'"))
    assert [tuple(r) for r in duplicate_codes(twice).collect()] == [("A", 2)]
    with pytest.raises(ValueError, match="'A' 2 times"):
        require_unique_codes(twice)


def test_only_rows_that_meet_sales_are_checked_for_repeats(table):
    master = table("master", ("A", "Apple", "F", "Fruit"), ("A", None, "F", "Fruit"))
    assert require_unique_codes(master) is master


def test_a_hot_item_can_be_split_with_the_salt(spark, tmp_path):
    """Without it, the sums of tumbling windows reuse the join's partitioning, hot task and all."""
    for name, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }.items():
        spark.conf.set(name, value)
    spark.range(0, 200000, 1, 8).select(
        F.lit("2024-01-01").alias("sales_date"),
        F.concat(F.lit("10:00:00."), (F.col("id") % 1000).cast("string")).alias("sales_time"),
        F.when(F.col("id") % 3 == 0, "A").otherwise((F.col("id") % 211).cast("string")).alias(
            "item_code"
        ),
        F.rand(1).alias("sales_quantity"),
        F.lit(1.0).alias("sales_price"),
        F.lit("sale").alias("sales_return"),
        F.lit("Y").alias("is_discount"),
    ).write.parquet(str(tmp_path / "sales"))
    sales = spark.read.parquet(str(tmp_path / "sales"))
    names = [F.lit("x").alias(c) for c in MASTER_COLUMNS[1:]]
    master = sales.select("item_code", *names).distinct()

    hours = WindowSettings("1 hour", "1 hour")
    join = JoinSettings(hot_items={"A": 2})
    salted = analyze_item_sales_data_statistics(
        process_item_sales_data(spark, sales, master, join), hours
    )
    joined = countable_sales(sales).join(master, "item_code")
    unsalted = analyze_item_sales_data_statistics(with_sales_amount(joined), hours)
    direct = sales_statistics(sales, master, hours)
    assert cents(salted) == cents(unsalted) == cents(direct)
    assert "SortMergeJoin(skew=true)" in plan(salted)
    assert "SortMergeJoin(skew=true)" not in plan(unsalted)
    assert "SortMergeJoin(skew=true)" not in plan(direct)
