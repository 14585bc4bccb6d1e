"""Windows, totals, order, and the two ways to the same report."""

import math
import random
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tillflow.operators.windows import assign_windows, order_statistics, slice_of, sums_of_slices
from tillflow.plans.process import process_item_sales_data
from tillflow.plans.statistics import analyze_item_sales_data_statistics, sales_statistics
from tillflow.schemas import STATISTICS_COLUMNS
from tillflow.settings import WindowSettings
from util import cents, count, plan, short

CASE_A = [
    "2024-01-01,10:00:00.000,A,1,2,sale,Y",
    "2024-01-01,10:07:00.000,A,3,2,sale,N",
    "2024-01-01,10:07:00.000,B,1,1,return,N",
    "2024-01-01,10:07:00.000,Z,1,1,sale,N",
    "2024-01-01,10:07:00.000,C,1,1,sale,N",
    "2024-01-01,10:07:00.000,B,1,1,sale,",
    "2024-01-01,10:40:00.000,B,1,5,sale,Y",
    "2024-01-01,10:01:00.000,A,100,1,sale,Y",
    "2024-01-01,10:21:00.000,A,7,1,sale,Y",
    "2024-01-01,11:40:00.000,B,1,5,sale,Y",
]
CASE_A_REPORT = [
    ("09:55", "10:05", "A", 102.0, 101.0),
    ("10:00", "10:10", "A", 108.0, 104.0),
    ("10:05", "10:15", "A", 6.0, 3.0),
    ("10:15", "10:25", "A", 7.0, 7.0),
    ("10:20", "10:30", "A", 7.0, 7.0),
    ("10:35", "10:45", "B", 5.0, 1.0),
    ("10:40", "10:50", "B", 5.0, 1.0),
    ("11:35", "11:45", "B", 5.0, 1.0),
    ("11:40", "11:50", "B", 5.0, 1.0),
]


@pytest.mark.parametrize(
    "time, expected",
    [
        ("2024-01-01 10:00:00", ["09:55-10:05", "10:00-10:10"]),
        ("2024-01-01 10:04:59.999", ["09:55-10:05", "10:00-10:10"]),
        ("2024-01-01 10:05:00", ["10:00-10:10", "10:05-10:15"]),
        ("1969-12-31 23:58:00", ["23:50-00:00", "23:55-00:05"]),
        (None, []),
    ],
)
def test_window_bounds(spark, time, expected):
    df = spark.createDataFrame([(time,)], "t STRING").select(
        F.col("t").cast("timestamp").alias("sales_datetime")
    )
    found = assign_windows(df)
    assert found.columns == ["window_start", "window_end", "sales_datetime"]
    bounds = [f"{r.window_start:%H:%M}-{r.window_end:%H:%M}" for r in found.collect()]
    assert sorted(bounds) == expected


WINDOWS_TRIED = [("10 minutes", "5 minutes"), ("1 hour", "1 hour"), ("7 minutes", "3 minutes")]
WINDOWS_TRIED += [("2 hours", "5 minutes"), ("90 seconds", "1 minute")]


def test_slices_tile_windows(spark):
    found = [slice_of(spark, WindowSettings(*w)) for w in WINDOWS_TRIED]
    seconds = [300, 3600, 60, 300, 30]
    assert found == [f"{s * 1_000_000} microseconds" for s in seconds]


def test_sales_are_summed_before_they_are_multiplied(spark, table, small_master, tmp_path):
    stored = written(spark, table, str(tmp_path / "sales"))
    text = plan(sales_statistics(stored, small_master, WindowSettings("2 hours", "5 minutes")))
    below = text[text.rindex("partial_sum") :]
    assert text.count("partial_sum") >= 2 and "Expand" in text
    assert "Expand" not in below and "FileScan" in below


def test_nothing_is_aggregated_after_it_is_multiplied(spark, table, small_master, tmp_path):
    """What a task holds must not grow with the number of windows a sale lies in."""
    stored = written(spark, table, str(tmp_path / "sales"))
    small_master.write.parquet(str(tmp_path / "master"))
    master = spark.read.parquet(str(tmp_path / "master"))
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for unique in (False, True):
            windows = WindowSettings("2 hours", "5 minutes")
            text = plan(sales_statistics(stored, master, windows, unique))
            above = text[: text.index("Expand")]
            assert not any(x in above for x in ("Aggregate", "Exchange", "Join", "Sort"))


SLICED = [(120, 5, 5), (7, 3, 1), (10, 4, 2), (10, 5, 5), (6, 6, 6)]


@pytest.mark.parametrize("length, slide, tile", SLICED)
@pytest.mark.parametrize("apart", [1, 9, 700])
def test_sums_of_slices_against_brute_force(spark, length, slide, tile, apart):
    """Around the epoch, at the ends of blocks, and with several rows a slice."""
    rng = random.Random(length * apart)
    at = [rng.randint(-60 * apart, 60 * apart) * tile for _ in range(120)]
    at += [12 * length * k + d * tile for k in (-1, 0, 1) for d in (-2, -1, 0, 1)]
    given = [(t, rng.choice("AAAB"), n % 7, n / 4) for n, t in enumerate(at)]
    expected = {}
    for t, key, n, x in given:
        for start in range(t - t % slide, t - length, -slide):
            old = expected.get((start, key), (0, 0.0))
            expected[start, key] = (old[0] + n, old[1] + x)
    slices = spark.createDataFrame(given, "t BIGINT, key STRING, n BIGINT, x DOUBLE")
    slices = slices.withColumn("sales_datetime", F.timestamp_seconds(F.col("t") * 60)).drop("t")
    windows = WindowSettings(f"{length} minutes", f"{slide} minutes")
    found = sums_of_slices(slices, ["key"], ["n", "x"], windows)
    assert found.columns == ["window_start", "window_end", "key", "n", "x"]
    start, end = (F.unix_seconds(f"window_{side}") / 60 for side in ("start", "end"))
    rows = found.select(start.cast("long"), (end - start).cast("long"), "key", "n", "x").collect()
    assert {r[1] for r in rows} == {length}
    assert len(rows) == len(expected)
    assert {(r[0], r.key): (r.n, r.x) for r in rows} == expected


@pytest.mark.parametrize("length, slide", WINDOWS_TRIED)
def test_windows_against_brute_force(spark, length, slide):
    rng = random.Random(11)
    minute = {"minutes": 60, "minute": 60, "hour": 3600, "hours": 3600, "seconds": 1}
    size, step = (int(t.split()[0]) * minute[t.split()[1]] * 1000 for t in (length, slide))
    times = [rng.randint(-(10**9), 2 * 10**12) for _ in range(500)]
    times += [step * k + d for k in range(-5, 5) for d in (-1, 0, 1)]
    expected = sorted(
        (start, start + size, t)
        for t in times
        for start in range(t - t % step, t - size, -step)
    )
    df = spark.createDataFrame([(t,) for t in times], "t BIGINT")
    windows = assign_windows(
        df.withColumn("sales_datetime", F.timestamp_millis("t")), WindowSettings(length, slide)
    )
    found = windows.select(F.unix_millis("window_start"), F.unix_millis("window_end"), "t")
    assert sorted(map(tuple, found.collect())) == expected


def test_a_slide_longer_than_the_window_is_refused(sales, small_master):
    with pytest.raises(AnalysisException):
        sales_statistics(sales("x"), small_master, WindowSettings("5 minutes", "10 minutes"))


def test_sums_that_are_not_numbers(spark, sales, small_master):
    """Infinite quantities are values; their product with a price of zero is NaN."""
    given = sales(
        "2024-01-01,10:00:00.000,A,Infinity,0,sale,Y", "2024-01-01,10:00:00.000,B,Infinity,2,sale,Y"
    )
    composed = analyze_item_sales_data_statistics(
        process_item_sales_data(spark, given, small_master)
    )
    for report in (composed, sales_statistics(given, small_master)):
        sums = {
            r.item_code: (r.total_sales_amount, r.total_sales_quantity) for r in report.collect()
        }
        assert math.isnan(sums["A"][0]) and sums["A"][1] == math.inf
        assert sums["B"] == (math.inf, math.inf)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_case_a_both_ways(spark, sales, small_master, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    composed = analyze_item_sales_data_statistics(
        process_item_sales_data(spark, sales(*CASE_A), small_master)
    )
    direct = sales_statistics(sales(*CASE_A), small_master)
    assert composed.columns == direct.columns == STATISTICS_COLUMNS
    assert composed.dtypes == direct.dtypes
    assert short(composed) == CASE_A_REPORT
    assert short(direct) == CASE_A_REPORT


@pytest.mark.parametrize("windows", [WindowSettings(*w) for w in WINDOWS_TRIED])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_direct_report_equals_process_then_analyze(spark, table, windows, seed):
    """Also with missing values, unparsable times, and codes listed repeatedly."""
    rng = random.Random(seed)
    maybe = lambda value, p=0.05: None if rng.random() < p else value
    sales = table(
        "sales",
        *[
            (
                maybe(rng.choice(["2024-01-01", "2024-01-02", "oops"])),
                maybe(f"{rng.randint(9, 11):02d}:{rng.randint(0, 59):02d}:00.{rng.randint(0, 999)}"),
                maybe(rng.choice("AAAAABCDEF")),
                maybe(float(rng.randint(-2, 9))) if rng.random() < 0.95 else math.nan,
                maybe(rng.randint(1, 10000) / 100),
                maybe(rng.choice(["sale", "sale", "return"])),
                maybe("N"),
            )
            for _ in range(1500)
        ],
    )
    master = table(
        "master",
        *[(maybe(c), maybe(n), maybe("K"), maybe("Kind")) for c in "AABBBCDE" for n in ("x", "y")],
        ("A", "x", "K", "Kind"),
        ("A", "x", "K", "Kind"),
    )
    composed = analyze_item_sales_data_statistics(
        process_item_sales_data(spark, sales, master), windows
    )
    direct = sales_statistics(sales, master, windows)
    expected = cents(composed)
    assert len(expected) > 50
    assert cents(direct) == expected


def test_watermark_is_inert_in_batch(spark, sales, small_master):
    processed = process_item_sales_data(spark, sales(*reversed(CASE_A)), small_master)
    assert short(analyze_item_sales_data_statistics(processed)) == CASE_A_REPORT
    assert "Watermark" not in plan(analyze_item_sales_data_statistics(processed))


def written(spark, table, path, n=2000):
    rng = random.Random(5)
    table(
        "sales",
        *[
            (
                "2024-01-01",
                f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00.000",
                rng.choice("AB"),
                1.0,
                2.0,
                "sale",
                "Y",
            )
            for _ in range(n)
        ],
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_sales_are_shuffled_once_as_partial_sums(spark, table, small_master, tmp_path):
    """With a master too large to broadcast as well as with a small one."""
    stored = written(spark, table, str(tmp_path / "sales"))
    small_master.write.parquet(str(tmp_path / "master"))
    master = spark.read.parquet(str(tmp_path / "master"))
    for threshold, joins in (("10MB", "BroadcastHashJoin"), ("-1", "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        text = plan(sales_statistics(stored, master))
        assert joins in text
        sales_side = text[: text.index("count(1)")]
        assert "partial_sum" in sales_side
        # The scan of the sales is below the slices' partial sums; no shuffle in between.
        below = sales_side[sales_side.rindex("partial_sum") :]
        assert "FileScan" in below
        scan = below[: below.index("FileScan")]
        assert "Exchange" not in scan and "Join" not in scan
        assert text.count("try_to_timestamp") == 1


def test_scan_reads_only_needed_columns(spark, table, small_master, tmp_path):
    stored = written(spark, table, str(tmp_path / "sales")).withColumn("note", F.lit("x"))
    stored.write.parquet(str(tmp_path / "wide"))
    text = plan(sales_statistics(spark.read.parquet(str(tmp_path / "wide")), small_master))
    assert "note" not in text


def test_order(spark, table, small_master, tmp_path):
    stored = written(spark, table, str(tmp_path / "sales"))
    ordered = order_statistics(sales_statistics(stored, small_master))
    assert count("rangepartitioning", ordered) == 1
    assert count("SinglePartition", ordered) == 0
    starts = [r.window_start for r in ordered.collect()]
    assert starts == sorted(starts) and len(starts) > 100


def test_order_is_ascending_within_the_whole_result(spark, sales, small_master):
    ordered = order_statistics(sales_statistics(sales(*CASE_A), small_master))
    found = [(f"{r.window_start:%H:%M}", r.item_code) for r in ordered.collect()]
    assert found == [(row[0], row[2]) for row in CASE_A_REPORT]


def test_renamed_item_splits_a_window(spark, sales, table):
    master = table("master", ("A", "Apple", "F", "Fruit"), ("A", "Pear", "F", "Fruit"))
    report = sales_statistics(sales("2024-01-01,10:00:00.000,A,1,2,sale,Y"), master)
    assert sorted((r.item_name, f"{r.window_start:%H:%M}") for r in report.collect()) == [
        ("Apple", "09:55"),
        ("Apple", "10:00"),
        ("Pear", "09:55"),
        ("Pear", "10:00"),
    ]


def test_windows_of_a_hot_item_stay_whole(spark, small_master):
    """Brute force over a fixture in which one item has nearly all sales."""
    sales = spark.range(4000).select(
        F.lit("2024-01-01").alias("sales_date"),
        F.concat(F.lit("10:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(":00.0"))
        .alias("sales_time"),
        F.when(F.col("id") % 100 == 0, "B").otherwise("A").alias("item_code"),
        (F.col("id") % 5).cast("double").alias("sales_quantity"),
        F.lit(1.5).alias("sales_price"),
        F.lit("sale").alias("sales_return"),
        F.lit("Y").alias("is_discount"),
    )
    expected = {}
    for i in range(4000):
        minute, item = i % 60, "B" if i % 100 == 0 else "A"
        first = minute - minute % 5
        for start in (first - 5, first):
            at = datetime(2024, 1, 1, 10 if start >= 0 else 9, start % 60)
            amount, quantity = expected.get((at, item), (0.0, 0.0))
            expected[at, item] = (amount + i % 5 * 1.5, quantity + i % 5)
    found = {
        (r.window_start, r.item_code): (r.total_sales_amount, r.total_sales_quantity)
        for r in sales_statistics(sales, small_master).collect()
    }
    assert found == expected
