"""Every registered query against its SQL, over the whole given tables."""

import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tillflow.registry.oracles import ORACLES
from tillflow.registry.queries import QUERIES
from tillflow.workspace import shared_folder

SF_DIR = os.environ.get("TILLFLOW_TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "bigint": "BIGINT"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return connection


def ordered(columns, rows):
    """Rows with columns by name, sorted, so that order does not matter."""
    by_name = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in by_name) for row in rows), key=repr)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert contract.queries().keys() >= QUERIES.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = contract.queries()[name](spark, SF_DIR)
    expected = duck.sql(contract.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    expected_types = dict(zip(expected.columns, map(str, expected.types)))
    assert {n: TYPES[kind] for n, kind in found.dtypes} == expected_types
    values = ordered(expected.columns, expected.fetchall())
    assert not any(isinstance(v, Decimal) for v in values[0])
    assert ordered(found.columns, map(tuple, found.collect())) == values


@pytest.mark.skipif(not SF_DIR.endswith("sf0.001"), reason="counts are for sf 0.001")
@pytest.mark.parametrize(
    "name, rows",
    [
        ("join_sales_master", 933),
        ("process_sales", 403),
        ("sales_statistics", 801),
        ("stream_statistics_append", 799),
    ],
)
def test_known_row_counts(spark, name, rows):
    assert contract.queries()[name](spark, SF_DIR).count() == rows


def test_queries_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    report = contract.queries()["sales_statistics"](spark, SF_DIR).collect()
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert len(report) == contract.queries()["sales_statistics"](spark, SF_DIR).count()


def test_entry(spark):
    report = contract.entry(spark)
    assert report.count() == 801 and not report.isStreaming


def test_sorted_report_is_sorted(spark):
    report = contract.queries()["sales_statistics_sorted"](spark, SF_DIR)
    starts = [r.window_start for r in report.collect()]
    assert starts == sorted(starts)


def test_written_tables_go_to_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, other = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one.startswith(root) and one != other


class ClusterSession:
    """What ``shared_folder`` sees of a session on a cluster without the setting."""

    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(ClusterSession, "x")
