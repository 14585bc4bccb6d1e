"""Sales messages from a Kafka topic. Needs Spark's Kafka connector package."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tillflow.schemas import SALES_TOPIC


@dataclass(frozen=True)
class KafkaSource:
    """Topic to subscribe to; ``None`` leaves a choice to Spark's default.

    ``max_offsets_per_trigger`` bounds a micro-batch, so that catching up
    after an outage does not become one huge batch. ``min_partitions`` reads a
    topic, or one crowded partition of it, with more tasks than it has
    partitions. ``options`` takes anything else, such as ``kafka.security.*``.
    """

    servers: str
    topic: str = SALES_TOPIC
    starting_offsets: str | None = None
    max_offsets_per_trigger: int | None = None
    min_partitions: int | None = None
    options: dict[str, str] = field(default_factory=dict, repr=False)

    def reader_options(self) -> dict[str, str]:
        chosen = {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": self.topic,
            "startingOffsets": self.starting_offsets,
            "maxOffsetsPerTrigger": self.max_offsets_per_trigger,
            "minPartitions": self.min_partitions,
            **self.options,
        }
        return {name: str(value) for name, value in chosen.items() if value is not None}


def stream_sales_messages(spark: SparkSession, source: KafkaSource) -> DataFrame:
    """Unbounded messages; the body is in the binary column ``value``."""
    return spark.readStream.format("kafka").options(**source.reader_options()).load()
