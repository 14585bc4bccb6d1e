"""Options handed to connectors that need an outside service.

No broker or database runs here. A recording reader shows what Spark would be
asked for, and the real reader shows that Spark accepts the call itself.
"""

import pytest
from pyspark.errors import AnalysisException

from tillflow.schemas import MASTER_COLUMNS, MASTER_SCHEMA, STATISTICS_SCHEMA
from tillflow.sinks.kafka import KafkaSink, statistics_writer
from tillflow.sources.jdbc import JdbcTable, read_master_jdbc
from tillflow.sources.kafka import KafkaSource, stream_sales_messages
from tillflow.streaming.job import start_statistics_job


class Recorder:
    """Stands in for ``spark.read``; keeps the arguments of ``jdbc``."""

    def __init__(self):
        self.read = self

    def jdbc(self, url, table, **arguments):
        self.url, self.table, self.arguments = url, table, arguments
        return self

    def select(self, *columns):
        self.columns = columns
        return self


def jdbc_call(**settings):
    recorder = Recorder()
    read_master_jdbc(recorder, JdbcTable("jdbc:x://host/db", **settings))
    return recorder


def test_jdbc_defaults_and_credentials_from_the_caller():
    call = jdbc_call(properties={"user": "u", "password": "p", "driver": "d"})
    assert (call.url, call.table) == ("jdbc:x://host/db", "item_master_table")
    assert call.arguments == {
        "properties": {
            "fetchsize": "10000",
            "user": "u",
            "password": "p",
            "driver": "d",
            "customSchema": MASTER_SCHEMA,
        }
    }
    assert jdbc_call(properties={"fetchsize": "7"}).arguments["properties"]["fetchsize"] == "7"
    assert list(call.columns) == MASTER_COLUMNS


def test_jdbc_parallel_reads():
    by_predicate = jdbc_call(predicates=["item_code < 'M'", "item_code >= 'M'"])
    assert by_predicate.arguments["predicates"] == ["item_code < 'M'", "item_code >= 'M'"]
    by_range = jdbc_call(column="id", lower_bound=0, upper_bound=1000, num_partitions=8)
    assert by_range.arguments | {"properties": None} == {
        "column": "id",
        "lowerBound": 0,
        "upperBound": 1000,
        "numPartitions": 8,
        "properties": None,
    }


@pytest.mark.parametrize(
    "given",
    [
        {"column": "id"},
        {"column": "id", "lower_bound": 0, "upper_bound": 9},
        {"lower_bound": 0},
        {"num_partitions": 4},
    ],
)
def test_ranges_need_all_their_settings(given):
    with pytest.raises(ValueError, match="column, lower_bound, upper_bound and num_partitions"):
        JdbcTable("jdbc:x", **given)


def test_predicates_and_ranges_exclude_each_other():
    ranges = {"column": "id", "lower_bound": 0, "upper_bound": 9, "num_partitions": 2}
    with pytest.raises(ValueError, match="either"):
        JdbcTable("jdbc:x", predicates=["1 = 1"], **ranges)


def test_credentials_are_not_printed():
    assert "secret" not in repr(JdbcTable("jdbc:x", properties={"password": "secret"}))
    assert "secret" not in repr(KafkaSource("s", options={"kafka.sasl.jaas.config": "secret"}))


@pytest.mark.parametrize(
    "split",
    [
        {},
        {"predicates": ["1 = 1"]},
        {"column": "id", "lower_bound": 0, "upper_bound": 9, "num_partitions": 3},
    ],
)
def test_spark_accepts_the_jdbc_call(spark, split):
    """It gets as far as looking for a driver for the made-up URL."""
    with pytest.raises(Exception, match="(?i)suitable driver|no suitable"):
        read_master_jdbc(spark, JdbcTable("jdbc:nosuchdatabase:x", **split))


def test_kafka_source_options():
    assert KafkaSource("h:1").reader_options() == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "sales_topic",
    }
    full = KafkaSource(
        "h:1,h:2",
        "t",
        starting_offsets="earliest",
        max_offsets_per_trigger=1000,
        min_partitions=64,
        options={"kafka.security.protocol": "SSL"},
    )
    assert full.reader_options() == {
        "kafka.bootstrap.servers": "h:1,h:2",
        "subscribe": "t",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "1000",
        "minPartitions": "64",
        "kafka.security.protocol": "SSL",
    }


def test_kafka_sink_options():
    assert KafkaSink("h:1").writer_options() == {
        "kafka.bootstrap.servers": "h:1",
        "topic": "sales_data_statistics_topic",
    }


def kafka_missing(spark):
    try:
        spark.readStream.format("kafka").option("subscribe", "t").option(
            "kafka.bootstrap.servers", "h:1"
        ).load()
    except AnalysisException:
        return True
    return False


def test_kafka_source_needs_the_connector(spark):
    if not kafka_missing(spark):
        pytest.skip("the Kafka connector is installed")
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        stream_sales_messages(spark, KafkaSource("h:1"))


def test_kafka_writer_is_refused_only_for_the_connector(spark, tmp_path):
    """A stream of statistics passes every check of a Kafka write but the connector."""
    if not kafka_missing(spark):
        pytest.skip("the Kafka connector is installed")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(STATISTICS_SCHEMA).json(str(tmp_path / "in"))
    writer = statistics_writer(stream, KafkaSink("h:1"), str(tmp_path / "checkpoint"))
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        writer.start()


def test_job_sets_up_the_session_before_it_reads(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    with pytest.raises(Exception, match="(?i)suitable driver"):
        start_statistics_job(
            spark,
            KafkaSource("h:1"),
            JdbcTable("jdbc:nosuchdatabase:x"),
            KafkaSink("h:1"),
            str(tmp_path / "checkpoint"),
        )
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.maxBroadcastTableSize") == "8589934592b"
