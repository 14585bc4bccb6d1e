"""Completeness, completed sales and the amount."""

import math
import random

from pyspark.sql import functions as F

from tillflow.operators.cleaning import (
    complete_rows,
    completed_sales,
    countable_sales,
    usable_master,
    with_sales_amount,
)
from util import plan, rows


def random_sales(table, n=500):
    rng = random.Random(3)
    maybe = lambda value: None if rng.random() < 0.1 else value
    return table(
        "sales",
        *[
            (
                maybe("2024-01-01"),
                maybe("10:00:00.000"),
                maybe("A"),
                maybe(rng.choice([1.0, 0.0, math.nan, math.inf])),
                maybe(rng.choice([2.0, math.nan])),
                maybe(rng.choice(["sale", "return"])),
                maybe("Y"),
            )
            for _ in range(n)
        ],
    )


def test_same_rows_as_dropna(table):
    given = random_sales(table)
    kept = complete_rows(given)
    assert rows(kept) == rows(given.dropna())
    assert 0 < kept.count() < given.count()


def test_checks_reach_the_scan(spark, table, tmp_path):
    random_sales(table).write.parquet(str(tmp_path / "sales"))
    text = plan(countable_sales(spark.read.parquet(str(tmp_path / "sales"))))
    pushed = text.split("PushedFilters: ")[1]
    for name in ("item_code", "sales_quantity", "sales_return", "is_discount"):
        assert f"IsNotNull({name})" in pushed
    assert "EqualTo(sales_return,sale)" in pushed


def test_each_text_is_parsed_once(spark, table, tmp_path):
    random_sales(table).write.parquet(str(tmp_path / "sales"))
    text = plan(countable_sales(spark.read.parquet(str(tmp_path / "sales"))))
    assert text.count("try_to_timestamp") == 1


def test_sale_is_matched_exactly(table):
    values = ["sale", "Sale", " sale", "sale ", "return", None]
    given = table("sales", *[("d", "t", "A", 1.0, 1.0, v, "Y") for v in values])
    assert [r.sales_return for r in completed_sales(given).collect()] == ["sale"]


def test_amount(table):
    given = table(
        "sales",
        ("d", "t", "A", 3.0, 2.5, "sale", "Y"),
        ("d", "t", "A", 1e308, 10.0, "sale", "Y"),
        ("d", "t", "A", None, 10.0, "sale", "Y"),
    )
    amounts = [r.sales_amount for r in with_sales_amount(given).collect()]
    assert amounts == [7.5, math.inf, None]


def test_other_columns_of_a_table_do_not_matter(table):
    given = table("sales", ("2024-01-01", "10:00:00.0", "A", 1.0, 1.0, "sale", "Y"))
    assert countable_sales(given.withColumn("note", F.lit(None).cast("string"))).count() == 1
    master = table("master", ("A", "Apple", "F", "Fruit"), ("B", "Bolt", None, "x"))
    noted = master.withColumn("note", F.lit(None).cast("string"))
    assert [r.item_code for r in usable_master(noted).collect()] == ["A"]
