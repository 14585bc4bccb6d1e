"""Records in, payloads out."""

import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillflow.functions.messages import (
    decode_sales,
    decode_statistics,
    decode_statistics_with_keys,
    encode_sales,
    encode_statistics,
)
from tillflow.schemas import MASTER_COLUMNS, SALES_COLUMNS, SALES_SCHEMA, STATISTICS_SCHEMA
from util import count, rows

DAY, TIME = "2024-01-01", "10:00:00.000"


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "line, expected",
    [
        (f"{DAY},{TIME},A,x,2,sale,Y", (DAY, TIME, "A", None, 2.0, "sale", "Y")),
        (f"{DAY},{TIME},A,1", (DAY, TIME, "A", 1.0, None, None, None)),
        ("", (None,) * 7),
        (None, (None,) * 7),
        (f"{DAY},{TIME}, A , 1 ,2, sale,Y", (DAY, TIME, " A ", 1.0, 2.0, " sale", "Y")),
        (f'"{DAY}",{TIME},"A,B",1,2,sale,', (DAY, TIME, "A,B", 1.0, 2.0, "sale", None)),
    ],
)
def test_record_parsing(spark, sales, ansi, line, expected):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    assert tuple(sales(line).first()) == expected


def test_surplus_field_and_nan(sales):
    row = sales("a,b,c,1,NaN,sale,Y,extra").first()
    assert math.isnan(row.sales_price)
    assert (row.sales_return, row.is_discount) == ("sale", "Y")


def test_columns_are_expanded(sales):
    assert sales("x").columns == SALES_COLUMNS


def test_sales_round_trip(table):
    given = table(
        "sales",
        (DAY, TIME, "A,1", 0.1, 1e300, "sale", None),
        (None, TIME, 'say "x"', None, -2.5, "return", "N"),
        (f" {DAY}", f"{TIME} ", " A ", 1.0, 2.0, " sale", "\tN\n"),
    )
    assert rows(decode_sales(encode_sales(given))) == rows(given)


def test_an_empty_text_comes_back_as_null(table):
    given = table("sales", (DAY, TIME, "", 1.0, 2.0, "sale", "N"))
    assert decode_sales(encode_sales(given)).first().item_code is None


def test_keys_come_back_beside_the_row(spark):
    given = statistics(spark, "Apple", " Pear ")
    both = decode_statistics_with_keys(encode_statistics(given))
    for r in both.collect():
        assert (r.key_window_start, r.key_window_end) == (r.window_start, r.window_end)
        assert [r[f"key_{c}"] for c in MASTER_COLUMNS] == [r[c] for c in MASTER_COLUMNS]
    assert count("StructsToJsonEvaluator", both) == 2


def statistics(spark, *names):
    start, end = datetime(2024, 1, 1, 9, 55), datetime(2024, 1, 1, 10, 5)
    data = [(start, end, "A", name, "F", "Fruit", 0.1 + 0.2, 3.0) for name in names]
    return spark.createDataFrame(data, STATISTICS_SCHEMA)


def test_payload_is_json_text_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    given = spark.sql(
        "SELECT TIMESTAMP '2024-01-01 09:55:00 UTC' window_start, "
        "TIMESTAMP '2024-01-01 10:05:00 UTC' window_end, 'A' item_code, 'Apple' item_name, "
        "'F' category_code, 'Fruit' category_name, "
        "2.5D total_sales_amount, 3.0D total_sales_quantity"
    )
    message = encode_statistics(given).first()
    assert json.loads(message.value) == {
        "window_start": "2024-01-01T09:55:00.000000Z",
        "window_end": "2024-01-01T10:05:00.000000Z",
        "item_code": "A",
        "item_name": "Apple",
        "category_code": "F",
        "category_name": "Fruit",
        "total_sales_amount": 2.5,
        "total_sales_quantity": 3.0,
    }
    assert decode_statistics(encode_statistics(given)).collect() == given.collect()


def test_payload_round_trip_and_column_types(spark):
    given = statistics(spark, "Apple")
    sent = encode_statistics(given)
    assert sent.dtypes == [("key", "string"), ("value", "string")]
    assert decode_statistics(sent).collect() == given.collect()


def test_key_is_stable_and_tells_renamed_items_apart(spark):
    keys = [r.key for r in encode_statistics(statistics(spark, "Apple", "Pear", "Apple")).collect()]
    assert keys[0] == keys[2] != keys[1]


def test_any_text_decodes_as_a_plain_projection_would(messages):
    """One row per message, whatever it holds, and the same fields."""
    rng = random.Random(9)
    pieces = [",", ",", ",", '"', "\\", " ", "\t", "\n", "\r", "1", "2.5", "NaN", "-Infinity", "1e400"]
    pieces += ["sale", "A", "é", " ", "\x00", "2024-01-01", "10:00:00.000", "'", "#", "null"]
    lines = ["".join(rng.choices(pieces, k=rng.randint(0, 16))) for _ in range(3000)]
    given = messages(None, *lines)
    plain = given.select(F.from_csv(F.col("value").cast("string"), SALES_SCHEMA).alias("r"))
    decoded = decode_sales(given)
    assert decoded.count() == len(lines) + 1
    # As text, since NaN does not equal itself.
    assert repr(rows(decoded)) == repr(rows(plain.select("r.*")))
