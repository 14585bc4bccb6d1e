"""Statistics to a Kafka topic. Needs Spark's Kafka connector package."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tillflow.functions.messages import encode_statistics
from tillflow.schemas import STATISTICS_TOPIC


@dataclass(frozen=True)
class KafkaSink:
    """Topic to publish to. Delivery is at least once; the key identifies a row."""

    servers: str
    topic: str = STATISTICS_TOPIC
    options: dict[str, str] = field(default_factory=dict, repr=False)

    def writer_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic, **self.options}


def statistics_writer(statistics: DataFrame, sink: KafkaSink, checkpoint: str) -> DataStreamWriter:
    """A configured, not yet started append-mode writer.

    ``checkpoint`` holds offsets and state and must outlive the cluster.
    """
    return (
        encode_statistics(statistics)
        .writeStream.format("kafka")
        .options(**sink.writer_options())
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
