"""Shared helpers: table access, lineage cuts, packed words and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step holds at a time (a longer text is its own step).
STEP_BYTES = 2 << 20
#: Most ids that are broadcast for a semi join; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Most parts of ids that are joined one after the other, each broadcast, before rows are shuffled.
PARTS = 8


#: Rows of an Arrow batch, where the session has Spark's default: whole texts may be long.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="keyfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Saved tables that only one step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame) -> DataFrame:
        """Cuts lineage with a Parquet table in the shared folder."""
        path = f"{shared_dir(self.spark)}/keyfold-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the tables; what was made of them must be written by then."""
        sc = self.spark.sparkContext
        for path in self.paths:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that go when the step has ended well; after a failure they stay to be looked at."""
    held = Scratch(spark)
    yield held
    held.clear()


def save(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, which stays: a result reads it."""
    return Scratch(df.sparkSession).save(df)


def only_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose id is in ids: broadcast up to BROADCAST_IDS, shuffled beyond."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, on, "left_semi")


def with_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df with the columns of ids that have their id: broadcast up to BROADCAST_IDS, shuffled beyond."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, on)


def parts(ids: DataFrame, on: str) -> list[Column]:
    """Conditions that deal ids out, so that each part can be broadcast: another scan for each instead of a shuffle of whole rows.

    Beyond PARTS there is one part, which is shuffled.
    """
    n = 1 + int(ids.count() / (0.9 * BROADCAST_IDS))  # parts by a hash are not quite even
    n = n if n <= PARTS else 1
    return [F.pmod(F.xxhash64(on), F.lit(n)) == k for k in range(n)]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), smallest id first.

    Alternating large-star and small-star steps: every step is a combinable
    minimum for each node and an equi-join, so a hub is never gathered in one task.
    A node that has no edge to another one is not returned. A round's table goes
    when the next one is written.
    """
    last = Scratch(edges.sparkSession)
    stars = last.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        following = Scratch(edges.sparkSession)
        stars = following.save(
            joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        last.clear()
        last = following
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                stars.select("v", "v").distinct()
            )
        state = now


# ---------------------------------------------------------------- packed words

_TABLE = np.random.default_rng(20240611).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, STEP_BYTES), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * STEP_BYTES:
            _POWERS[name] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different salts give independent orders."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def steps(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into (first row, row count, bytes, offsets) of about size bytes."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, end - at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def ascii_lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


class Words:
    """The words of a step: start, end (bytes), row of each, and word offsets of rows."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool = True):
        self.data = ascii_lower()[data] if lower else data
        word = np.zeros(len(data) + 1, np.int8)
        word[:-1] = inside[self.data]
        edge = word.copy()
        edge[1:] -= word[:-1]
        cuts = off[1:-1]  # a row's first byte starts a word of its own
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[(word[cuts] == 1) & (word[cuts - 1] == 1)]
        self.start = np.sort(np.concatenate([np.flatnonzero(edge == 1), cuts]))
        self.end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cuts]))
        self.rows = np.searchsorted(self.start, off)  # offsets of each row's words

    def hashes(self, head: int | None = None) -> np.ndarray:
        """Hashes of all words, or of the first bytes (at most head) of each."""
        end = self.end if head is None else np.minimum(self.end, self.start + head)
        with np.errstate(over="ignore"):
            n = len(self.data)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * _powers("r", _R, n), dtype=np.uint64, out=sums[1:])
            inverse = _powers("i", _RINV, n + 1)
            return mix((sums[end] - sums[self.start]) * inverse[self.start])


def grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their rows; a row with fewer words has its whole sequence as one."""
    with np.errstate(over="ignore"):
        counts = np.diff(rows)
        own = np.repeat(np.arange(len(counts)), counts)
        full = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            full = full * np.uint64(0xC6A4A7935BD1E995) + words[k : len(words) - n + 1 + k]
        same = own[: len(full)] == own[n - 1 :] if len(full) else np.zeros(0, bool)
        out, at = mix(full[same], n), own[: len(full)][same]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                here = counts[short] > k
                extra[here] = extra[here] * np.uint64(0xC6A4A7935BD1E995) + words[rows[short[here]] + k]
            out, at = np.concatenate([out, mix(extra + counts[short].astype(np.uint64), n + 100)]), np.concatenate([at, short])
    return out, at


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list<int64> column from flat 64-bit values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each range, one after the other."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)
