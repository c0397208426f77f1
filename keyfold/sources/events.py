"""Sources of events and sinks of deltas and dead letters.

A source is a DataFrame, streaming or not, with the columns of the Kafka reader:
key, value (binary), topic, partition, offset, timestamp. Kafka needs Spark's
connector on the class path; the file source serves the same rows from JSON lines.

A sink has ``deltas(df, batch_id)`` and ``dead(df, batch_id)``; both give the same rows for
a replayed batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("key", "value", "topic", "partition", "offset", "timestamp")
#: Headers of a delta.
HEADERS = ("event_id", "correlation_id", "causation_topic", "causation_partition", "causation_offset", "state_version", "produced_at")


def kafka(spark: SparkSession, servers: str, topics: list[str], start: str = "latest", batch_count: int = 100_000, options: dict[str, str] | None = None) -> DataFrame:
    """A stream of topics; `batch_count` bounds a micro-batch."""
    if start not in ("earliest", "latest"):
        raise ValueError("start is earliest or latest")
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    reader = reader.option("startingOffsets", start).option("maxOffsetsPerTrigger", batch_count).options(**(options or {}))
    return reader.load().select(*COLUMNS)


def json_files(spark: SparkSession, path: str, topic: str, files_per_batch: int = 1, streaming: bool = True) -> DataFrame:
    """Lines of text files as events, without a key or an offset (the runner numbers the lines of a batch)."""
    if streaming:
        lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)
    else:
        lines = spark.read.text(path)
    return lines.select(
        F.lit(None).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
        F.col("_metadata.file_modification_time").alias("timestamp"),
    )


def as_raw(rows: DataFrame, topic: str, value, order) -> DataFrame:
    """Table rows as raw events: `value` gives the JSON text, `order` the offset."""
    return rows.select(
        F.lit(None).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        order.cast("bigint").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )


def _header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.encode(F.coalesce(value.cast("string"), F.lit("")), "utf-8").alias("value"))


def kafka_rows(deltas: DataFrame) -> DataFrame:
    """Deltas as rows of the Kafka writer, ids and causation as headers; of a session, -1 stands before +1."""
    held = [_header(n, F.col(n)) for n in HEADERS if n in deltas.columns]
    return deltas.select(F.col("key").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value"), "topic", F.array(*held).alias("headers"))


def dead_letters(malformed: DataFrame, topic: str, error: str = "malformed JSON") -> DataFrame:
    """Malformed events as rows of the Kafka writer: the raw payload, where it came from as headers."""
    place = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    headers = {"error": F.lit(error), "source_topic": F.col("topic"), "partition": F.col("partition"), "offset": F.col("offset"), "ts": F.unix_millis("timestamp")}
    held = [_header(n, c) for n, c in headers.items()]
    return malformed.select(place.cast("binary").alias("key"), "value", F.lit(topic).alias("topic"), F.array(*held).alias("headers"))


class Sink(Protocol):
    """Where a batch's deltas and dead letters (rows of `dead_letters`) go."""

    dead_topic: str

    def deltas(self, rows: DataFrame, batch_id: int) -> None: ...

    def dead(self, rows: DataFrame, batch_id: int) -> None: ...


@dataclass
class FileSink:
    """Parquet by batch, deltas by topic in it; a replayed batch replaces its own files."""

    path: str
    dead_topic: str = "dead-letters"

    def deltas(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").partitionBy("topic").parquet(f"{self.path}/deltas/batch={batch_id}")

    def dead(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/dead_letters/batch={batch_id}")


@dataclass
class KafkaSink:
    """The Kafka writer (at least once: a replayed batch is sent again with the same event ids)."""

    servers: str
    dead_topic: str = "dead-letters"
    options: dict[str, str] = field(default_factory=dict)
    format: str = "kafka"

    def deltas(self, rows: DataFrame, batch_id: int) -> None:
        self._send(kafka_rows(rows))

    def dead(self, rows: DataFrame, batch_id: int) -> None:
        self._send(rows)

    def _send(self, rows: DataFrame) -> None:
        rows.write.format(self.format).mode("append").option("kafka.bootstrap.servers", self.servers).option("includeHeaders", "true").options(**self.options).save()
