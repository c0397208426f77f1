"""The streaming run: one Catalyst plan for each micro-batch.

    events -> tag -> fold (by session) -> join with the stored state -> deltas

Deltas are written first, then the state, then Spark commits the batch. A replayed
batch id reads the state before it and replaces its own files: it gives the same result.
There is no event-time watermark: late events meet by their comparators. Events of a session arrive
in the order of their offsets in a partition (sessions are keyed to partitions; of several
partitions the order is that of topic and partition, and the metrics count such sessions).
"""

from __future__ import annotations

import logging
import signal
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keyfold.operators import fold, ingest, transition
from keyfold.operators.schema import Schema, Transformer
from keyfold.sources.enrichment import Enrichment
from keyfold.sources.events import FileSink, Sink, dead_letters
from keyfold.sources.state import StateTable

log = logging.getLogger(__name__)

#: Restarts after failures in a row, and the longest wait before one, in seconds.
MOST_RESTARTS, LONGEST_WAIT = 6, 64


def state_type(spark: SparkSession, schema: Schema) -> StructType:
    """The columns of the state of raw events; nothing runs."""
    raw = spark.createDataFrame([], "value string, seq struct<topic:string,partition:int,offset:bigint>")
    local = fold.fold(ingest.admitted(ingest.parse_records(raw), schema, "record"), schema, "record")
    return fold.elided(local, schema).schema


@dataclass
class Runner:
    """`state` is a StateTable or anything with its `before`, `write` and `compact`; `sink` likewise."""

    spark: SparkSession
    schema: Schema
    transformer: Transformer
    path: str
    clock: Callable[[], float] = time.time
    dry_run: bool = False
    emit: Callable[[DataFrame, int], None] | None = None
    enrichment: Enrichment | None = None
    sink: Sink | None = None
    state: StateTable | None = None
    compact_every: int = 20
    buckets: int = 64
    metrics: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.sink = self.sink or FileSink(self.path)
        self.state = self.state or StateTable(self.spark, f"{self.path}/state", state_type(self.spark, self.schema), self.schema.version, clock=self.clock, buckets=self.buckets)
        self._stop, self._busy, self._made = threading.Event(), False, {}

    # ------------------------------------------------------------ one batch

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of raw events (the columns of sources.events); refused once a stop was asked for."""
        if self._stop.is_set():
            raise InterruptedError("the run is stopping")
        self._busy = True
        try:
            self._process(batch, batch_id)
        finally:
            self._busy = False

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        began, seen, folded, sent = time.time(), Observation(), Observation(), Observation()
        batch = batch.withColumn("offset", F.coalesce("offset", F.monotonically_increasing_id()))
        tagged = self._observed(ingest.tag(ingest.parse_records(batch), self.schema, "record", self._made), seen).persist()
        local = states = None
        try:
            kept = tagged.where(F.col("tag") == ingest.ADMITTED).withColumn("seq", F.struct("topic", "partition", "offset"))
            place = F.struct("seq.topic", "seq.partition")
            local = fold.fold(kept, self.schema, "record", also={"cause": F.max("seq"), "split": F.min(place) != F.max(place)}, made=self._made)
            local = local.observe(folded, F.count(F.lit(1)).alias("sessions"), F.count_if("split").alias("sessions_on_several_partitions")).drop("split").persist()
            stored = self.state.before(batch_id, local.select("session_key"))
            states = fold.merge(stored, local, self.schema, self._made).select(
                "session_key", "old", "new", *(F.col(f"cause.{c}").alias(f"causation_{c}") for c in ("topic", "partition", "offset"))
            ).persist()
            now = int(self.clock())
            stamps = {"state_version": F.lit(self.schema.version), "produced_at": F.lit(now).cast("bigint")}
            out = transition.deltas(states, self.transformer, now, enrichment=self.enrichment and self.enrichment.rows(), made=self._made).withColumns(stamps)
            topics = sorted({s.topic for s in self.transformer.streams})
            out = out.observe(sent, F.count(F.lit(1)).alias("deltas"), *(F.count_if(F.col("topic") == t).alias(f"deltas to {t}") for t in topics))
            if self.dry_run:
                (self.emit or (lambda d, _: d.show(truncate=False)))(out, batch_id)
            else:
                (self.emit or self.sink.deltas)(out, batch_id)
                self.sink.dead(dead_letters(tagged.where(F.col("tag") == ingest.MALFORMED), self.sink.dead_topic), batch_id)
                self.state.write(states.select("session_key", "new.*"), batch_id)
                if self.compact_every and (batch_id + 1) % self.compact_every == 0:
                    self.state.compact(batch_id)
            self.metrics.append({"batch": batch_id, "seconds": round(time.time() - began, 3), **seen.get, **folded.get, **sent.get, "lag": self._lag(tagged)})
            log.info("batch", extra={"figures": self.metrics[-1]})
        finally:
            for held in (states, local, tagged):
                if held is not None:
                    held.unpersist()

    def _observed(self, tagged: DataFrame, seen: Observation) -> DataFrame:
        other_key = F.col("session_key").isNotNull() & F.col("key").isNotNull() & (F.col("key").cast("string") != F.col("session_key"))
        return tagged.observe(
            seen,
            F.count(F.lit(1)).alias("events"),
            *(F.count_if(F.col("tag") == t).alias(t) for t in (ingest.ADMITTED, ingest.FILTERED, ingest.MALFORMED)),
            F.min(F.unix_millis("timestamp")).alias("oldest_ms"),
            F.count_if(other_key).alias("key_mismatch"),
        )

    def _lag(self, tagged: DataFrame) -> dict[str, float]:
        """Seconds from the newest event of each partition to now; one row for each partition of the source."""
        rows = tagged.groupBy("topic", "partition").agg(F.max(F.unix_millis("timestamp")).alias("ms")).where("ms IS NOT NULL").collect()
        return {f"{r['topic']}:{r['partition']}": round(self.clock() - r["ms"] / 1000, 3) for r in rows}

    # ------------------------------------------------------------ the run

    def start(self, source: DataFrame, interval: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
        """Runs a streaming source; without an interval all that is there, then it ends.

        A dry run has a checkpoint of its own, so that it moves no offset of the real run.
        """
        place = checkpoint or (f"{self.path}/inspect/{uuid.uuid4().hex}" if self.dry_run else f"{self.path}/checkpoint")
        writer = source.writeStream.foreachBatch(self.process).option("checkpointLocation", place)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def stop(self, *_) -> None:
        """Asks a run to end after the batch it is in."""
        self._stop.set()

    def run(self, source: DataFrame, interval: str | None = None, wait: Callable[[float], object] | None = None) -> int:
        """Runs to the end, or until SIGTERM, SIGINT or `stop`; 0 if it ended well.

        A failed query is started again from its checkpoint after 2, 4, ... seconds, at most
        MOST_RESTARTS times in a row; a batch that gets through starts the count anew.
        """
        before = {}
        if threading.current_thread() is threading.main_thread():
            before = {s: signal.signal(s, self.stop) for s in (signal.SIGTERM, signal.SIGINT)}
        wait, failures, place = wait or self._stop.wait, 0, f"{self.path}/inspect/{uuid.uuid4().hex}" if self.dry_run else None
        try:
            while not self._stop.is_set():
                done = len(self.metrics)
                try:
                    if self._watch(self.start(source, interval, place)):
                        return 0
                except Exception as e:  # noqa: BLE001  whatever ended the query, it may get through later
                    if self._stop.is_set():
                        return 0
                    failures = 1 if len(self.metrics) > done else failures + 1
                    log.warning("query failed", extra={"figures": {"error": str(e).splitlines()[0], "failures": failures}})
                    if failures > MOST_RESTARTS:
                        raise
                    wait(min(2**failures, LONGEST_WAIT))
            return 0
        finally:
            for s, handler in before.items():
                signal.signal(s, handler)
            if place:
                self._forget(place)

    def _watch(self, query: StreamingQuery) -> bool:
        while not query.awaitTermination(0.2):
            # between batches: what has begun is finished and committed, and no other begins
            if self._stop.is_set() and not self._busy and not query.status["isTriggerActive"]:
                query.stop()
        return True

    def _forget(self, place: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
