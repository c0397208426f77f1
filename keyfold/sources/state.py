"""The state table: what each batch changed, and now and then a snapshot of all sessions.

    {path}/parts/batch=N/bucket=B/     rows that batch N changed
    {path}/full/upto=N/bucket=B/       the latest row of every session after batch N

Rows lie in `buckets` folders by a hash of the session key (a number that stays for the life of a table). Batch n reads the last snapshot before it and the
parts since, of the buckets that its own sessions fall into, and of these the sessions it asks
for (their keys are broadcast up to BROADCAST_KEYS, joined by a shuffle beyond), so that its cost
follows the batch and not the age of the stream. A replayed batch sees the same state and replaces its
own part: a counter does not count twice. The last two snapshots and the parts since the older one stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Most keys of a batch that are broadcast to the scan of the stored state.
BROADCAST_KEYS = 1_000_000


@dataclass
class StateTable:
    """`upcasts` has, for an older version, the columns of its rows and a function from them to rows of today's columns."""

    spark: SparkSession
    path: str
    schema: StructType  # session_key and the state columns
    version: int = 1
    ttl_secs: float | None = None  # sessions that no batch has changed for so long count as absent
    clock: Callable[[], float] | None = None
    buckets: int = 64
    upcasts: dict[int, tuple[StructType, Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ folders

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, kind: str, name: str) -> list[int]:
        """Numbers of the folders `name=N` that were written whole."""
        fs, at = self._fs(f"{self.path}/{kind}")
        if not fs.exists(at):
            return []
        held = [str(s.getPath().getName()) for s in fs.listStatus(at)]
        held = [h for h in held if h.startswith(f"{name}=") and self._exists(f"{self.path}/{kind}/{h}/_SUCCESS")]
        return sorted(int(h.partition("=")[2]) for h in held)

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _live(self, before: int) -> list[str]:
        """Folders that hold the state ahead of a batch."""
        if self._exists(f"{self.path}/parts") and not self._exists(f"{self.path}/of-{self.buckets}"):
            raise ValueError(f"{self.path} was written with another number of buckets")
        full = [n for n in self._numbers("full", "upto") if n < before]
        since = full[-1] if full else -1
        parts = [f"{self.path}/parts/batch={n}" for n in self._numbers("parts", "batch") if since < n < before]
        return [f"{self.path}/full/upto={n}" for n in full[-1:]] + parts

    # ------------------------------------------------------------ reads

    def _rows(self, folders: list[str], schema: StructType) -> DataFrame:
        """Rows of some folders with the batch that wrote them, their time, version and bucket."""
        full = StructType([*schema.fields, *(StructField(n, LongType()) for n in ("state_version", "batch", "changed_at"))]).add("bucket", "integer")
        if not folders:
            return self.spark.createDataFrame([], full)
        return _union([self.spark.read.schema(full).parquet(f) for f in folders])

    def before(self, batch_id: int, keys: DataFrame | None = None) -> DataFrame:
        """State ahead of a batch (of the given session_key rows)."""
        folders, names = self._live(batch_id), [n for n in self.schema.names if n != "session_key"]
        buckets, small = None, False
        if keys is not None and folders:
            found = keys.groupBy(self.bucket_of(F.col("session_key"))).count().collect()  # a row for each bucket
            buckets, small = [r[0] for r in found], sum(r[1] for r in found) <= BROADCAST_KEYS

        def wanted(rows: DataFrame, version: int) -> DataFrame:
            rows = rows.where(F.col("state_version") == version)
            if buckets is not None:
                rows = rows.where(F.col("bucket").isin(*buckets))
            if keys is not None:
                asked = keys.select("session_key")
                rows = rows.join(F.broadcast(asked) if small else asked, "session_key", "left_semi")
            return rows

        meta = ("batch", "changed_at")
        rows = wanted(self._rows(folders, self.schema), self.version).select("session_key", *names, *meta)
        for version, (schema, upcast) in self.upcasts.items():
            old = wanted(self._rows(folders, schema), version).select(*schema.names, *meta)
            rows = rows.unionByName(upcast(old).select("session_key", *names, *meta))
        latest = rows.groupBy("session_key").agg(F.max_by(F.struct("changed_at", *names), "batch").alias("s"))
        if self.ttl_secs is not None:
            latest = latest.where(F.col("s.changed_at") >= F.lit(int((self.clock() - self.ttl_secs) * 1000)))
        return latest.select("session_key", *(F.col(f"s.{n}").alias(n) for n in names))

    def current(self) -> DataFrame:
        return self.before(2**62)

    def get(self, key: str) -> dict | None:
        """Point lookup of one session in its bucket: its version and state as JSON text."""
        rows = self._rows(self._live(2**62), self.schema).where((F.col("bucket") == self.bucket_of(F.lit(key))) & (F.col("session_key") == key))
        if self.ttl_secs is not None:
            rows = rows.where(F.col("changed_at") >= F.lit(int((self.clock() - self.ttl_secs) * 1000)))
        shown = F.to_json(F.struct(*[n for n in self.schema.names if n != "session_key"]))
        row = rows.orderBy(F.desc("batch")).select("state_version", shown.alias("state")).first()
        return row and row.asDict()

    # ------------------------------------------------------------ writes

    def write(self, state: DataFrame, batch_id: int) -> None:
        """The sessions that a batch changed."""
        now = int(self.clock() * 1000) if self.clock else 0
        rows = state.select(*self.schema.names, *(F.lit(x).cast("long").alias(n) for n, x in (("state_version", self.version), ("batch", batch_id), ("changed_at", now))))
        self._put(rows, f"{self.path}/parts/batch={batch_id}")

    def _put(self, rows: DataFrame, path: str) -> None:
        fs, at = self._fs(f"{self.path}/of-{self.buckets}")
        fs.mkdirs(at)
        placed = rows.withColumn("bucket", self.bucket_of(F.col("session_key")))
        # a task writes whole buckets, several where a bucket is large: few files
        placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def compact(self, batch_id: int) -> None:
        """A snapshot as of the end of a batch; what only replays of older batches could ask for goes."""
        names = [n for n in self.schema.names if n != "session_key"]
        rows = self._rows(self._live(batch_id + 1), self.schema)
        if self.ttl_secs is not None:
            rows = rows.where(F.col("changed_at") >= F.lit(int((self.clock() - self.ttl_secs) * 1000)))
        held = ("state_version", "batch", "changed_at", *names)
        latest = rows.groupBy("session_key").agg(F.max_by(F.struct(*held), "batch").alias("s")).select("session_key", "s.*")
        self._put(latest.select(*self.schema.names, "state_version", "batch", "changed_at"), f"{self.path}/full/upto={batch_id}")
        full = self._numbers("full", "upto")
        oldest = full[-2] if len(full) > 1 else -1
        gone = [f"full/upto={n}" for n in full if n < oldest] + [f"parts/batch={n}" for n in self._numbers("parts", "batch") if n <= oldest]
        for name in gone:
            fs, at = self._fs(f"{self.path}/{name}")
            fs.delete(at, True)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
