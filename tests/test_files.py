"""CSV in, CSV out, and the batch job between them."""

import glob

import pytest

from tillflow.plans.batch_job import run_batch_job
from tillflow.plans.statistics import sales_statistics
from tillflow.schemas import GROUP_COLUMNS, SALES_SCHEMA, STATISTICS_COLUMNS, STATISTICS_SCHEMA
from tillflow.sinks.files import write_statistics
from tillflow.sources.files import read_csv, read_master, read_sales, read_statistics_csv
from test_statistics import CASE_A, CASE_A_REPORT
from util import plan, rows, short

SALES_HEADER = "sales_date,sales_time,item_code,sales_quantity,sales_price,sales_return,is_discount"
MASTER_HEADER = "item_code,item_name,category_code,category_name"
MASTER = ["A,Apple,F,Fruit", "B,Bolt,H,Hardware", "C,Cup,,Kitchen"]


@pytest.fixture
def inputs(tmp_path):
    (tmp_path / "sales.csv").write_text("\n".join([SALES_HEADER, *CASE_A]) + "\n")
    (tmp_path / "master.csv").write_text("\n".join([MASTER_HEADER, *MASTER]) + "\n")
    return str(tmp_path / "sales.csv"), str(tmp_path / "master.csv")


def test_declared_schema(spark, inputs):
    sales, master = read_sales(spark, inputs[0]), read_master(spark, inputs[1])
    assert sales.count() == len(CASE_A)
    assert sales.schema.simpleString() == (
        "struct<sales_date:string,sales_time:string,item_code:string,sales_quantity:double,"
        "sales_price:double,sales_return:string,is_discount:string>"
    )
    assert all(f.nullable for f in [*sales.schema, *master.schema])
    assert rows(master)[-1] == ("C", "Cup", None, "Kitchen")


def test_columns_bind_by_position_unless_the_header_is_checked(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("item_name,item_code,category_code,category_name\nA,Apple,F,Fruit\n")
    assert read_master(spark, str(path)).first().item_code == "A"
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_master(spark, str(path), check_header=True).collect()


def test_columnar_input(spark, table, tmp_path):
    given = table("master", ("A", "Apple", "F", "Fruit"))
    for fmt in ("parquet", "orc"):
        given.write.format(fmt).save(str(tmp_path / fmt))
        assert rows(read_master(spark, str(tmp_path / fmt), fmt)) == rows(given)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_sale_filter_reaches_file_scans(spark, sales, small_master, tmp_path, fmt):
    sales(*CASE_A).write.format(fmt).option("header", True).save(str(tmp_path / "sales"))
    stored = read_sales(spark, str(tmp_path / "sales"), fmt)
    text = plan(sales_statistics(stored, small_master))
    assert "EqualTo(sales_return,sale)" in text


def test_batch_job(spark, inputs, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run replaces the first
        run_batch_job(spark, *inputs, out, check_header=True)
    assert short(read_csv(spark, out, STATISTICS_SCHEMA, check_header=True)) == CASE_A_REPORT


def test_batch_job_refuses_a_repeated_code(spark, inputs, tmp_path):
    with open(inputs[1], "a") as master:
        master.write("A,Apfel,F,Fruit\n")
    with pytest.raises(ValueError, match="'A' 2 times"):
        run_batch_job(spark, *inputs, str(tmp_path / "out"))
    run_batch_job(spark, *inputs, str(tmp_path / "out"), unique_master=False)
    report = read_csv(spark, str(tmp_path / "out"), STATISTICS_SCHEMA)
    assert report.count() == len(CASE_A_REPORT) + 5


def test_output_format(spark, inputs, tmp_path):
    report = sales_statistics(read_sales(spark, inputs[0]), read_master(spark, inputs[1]))
    write_statistics(report, str(tmp_path / "one"), files=1)
    parts = glob.glob(str(tmp_path / "one" / "part-*.csv"))
    assert len(parts) == 1
    lines = open(parts[0]).read().splitlines()
    assert lines[0] == ",".join(STATISTICS_COLUMNS)
    assert lines[1] == (
        "2024-01-01T09:55:00.000Z,2024-01-01T10:05:00.000Z,A,Apple,F,Fruit,102.0,101.0"
    )
    assert [line.split(",")[2] for line in lines[1:]] == [row[2] for row in CASE_A_REPORT]


@pytest.mark.parametrize("files", [None, 1, 3])
def test_files_in_name_order_are_sorted(spark, inputs, tmp_path, files):
    report = sales_statistics(read_sales(spark, inputs[0]), read_master(spark, inputs[1]))
    write_statistics(report, str(tmp_path / "out"), files)
    parts = sorted(glob.glob(str(tmp_path / "out" / "part-*.csv")))
    if files:
        assert len(parts) <= files
    starts = [line.split(",")[0] for part in parts for line in open(part).read().splitlines()[1:]]
    assert starts == sorted(starts) and len(starts) == len(CASE_A_REPORT)


def test_single_file_keeps_the_aggregation_parallel(spark, inputs):
    report = sales_statistics(read_sales(spark, inputs[0]), read_master(spark, inputs[1]))
    one = report.repartitionByRange(1, *GROUP_COLUMNS).sortWithinPartitions(*GROUP_COLUMNS)
    text = plan(one)
    assert "Coalesce" not in text
    assert "hashpartitioning(window_start" in text


def test_sales_schema_has_seven_fields(spark):
    assert len(spark.createDataFrame([], SALES_SCHEMA).columns) == 7


@pytest.mark.parametrize("files", [None, 1])
def test_a_report_without_rows_still_has_a_header(spark, inputs, tmp_path, files):
    (tmp_path / "none.csv").write_text(SALES_HEADER + "\n" + CASE_A[2] + "\n")
    out = str(tmp_path / "out")
    run_batch_job(spark, str(tmp_path / "none.csv"), inputs[1], out, files=files)
    report = read_csv(spark, out, STATISTICS_SCHEMA, check_header=True)
    assert report.collect() == []
    parts = glob.glob(out + "/part-*.csv")
    assert [open(part).read().strip() for part in parts] == [",".join(STATISTICS_COLUMNS)]


ODD_TEXTS = ["A", " A", "A ", " ", "Bolt\nM6", 'say "x", twice', "back\\slash", "cr\r\nlf", "é,;|"]


@pytest.fixture
def odd_inputs(table, tmp_path):
    sale = ("2024-01-01", "10:00:00.000")
    sales = table("sales", *[(*sale, t, 1.0, 2.0, "sale", "Y") for t in ODD_TEXTS])
    master = table("master", *[(t, f" {t} ", t, "x ") for t in ODD_TEXTS])
    sales.write.parquet(str(tmp_path / "sales"))
    master.write.parquet(str(tmp_path / "master"))
    return str(tmp_path / "sales"), str(tmp_path / "master")


@pytest.mark.parametrize("files", [None, 1])
def test_odd_texts_come_back_from_csv(spark, odd_inputs, tmp_path, files):
    report = sales_statistics(*(spark.read.parquet(p) for p in odd_inputs))
    assert report.count() == 2 * len(ODD_TEXTS)
    write_statistics(report, str(tmp_path / "out"), files)
    assert rows(read_statistics_csv(spark, str(tmp_path / "out"))) == rows(report)


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc"])
def test_odd_texts_come_back_from_the_batch_job(spark, odd_inputs, tmp_path, fmt):
    out = str(tmp_path / "out")
    run_batch_job(spark, *odd_inputs, out, fmt="parquet", output_fmt=fmt)
    report = sales_statistics(*(spark.read.parquet(p) for p in odd_inputs))
    read = read_statistics_csv(spark, out) if fmt == "csv" else spark.read.format(fmt).load(out)
    assert rows(read) == rows(report)


def test_the_batch_job_reads_the_master_once(spark, inputs, tmp_path, monkeypatch):
    from tillflow.plans import batch_job

    found = {}
    write = batch_job.write_statistics

    def watch(report, *arguments):
        found["plan"] = plan(report)
        write(report, *arguments)

    monkeypatch.setattr(batch_job, "write_statistics", watch)
    run_batch_job(spark, *inputs, str(tmp_path / "out"))
    assert "InMemoryTableScan" in found["plan"] and "count(1)" not in found["plan"]
    assert short(read_statistics_csv(spark, str(tmp_path / "out"))) == CASE_A_REPORT
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0
