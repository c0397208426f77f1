"""Embedding near-duplicates by p-stable hashing for the Euclidean distance.

Vectors of one label (and length) are normalised, projected on Gaussian directions
for each of several tables, shifted, and cut into steps of WIDTH; the step numbers
of a table together name a bucket. Vectors that share a bucket are compared exactly, by
cosine in double precision, so that nothing below the threshold is ever linked. A
pair at distance d falls into the same step with a probability known in closed
form (`same_step`). From it `plan` takes the directions of a table, so that chance meetings
of far vectors stay at CHANCE for a vector over all tables however many rows there
are, and then the tables, so that a pair right at the threshold is missed with a probability
of at most MISSED; closer pairs are surer.

Equal vectors are one vector with a count until the end. What is shuffled for a table is a
64-bit bucket name beside the vector's id; embeddings follow only those that share a bucket.
A bucket of more than BLOCK vectors is cut into blocks that meet pairwise, and pairs of blocks are
dealt to cells of about CELL rows, so that no bucket is gathered; what leaves a cell are sums and
one link for a vector, not pairs. A pair found in several tables counts in the first one only.
WIDTH is where the tables that are needed grow slowest with the rows: as their power 0.115.

Defined results: vectors that are null, empty, zero or that hold null or
non-finite components, and vectors with a null label, link with nothing; vectors of
different lengths do not link; labels are of any type that can be grouped; repeated rows link as
equal vectors do (n_links counts rows); a null vec_id has no links and keeps a row; vectors of any length
are whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, mix, ragged, save, scratch, table

WIDTH, SEED = 2.0, 7
#: Chance meetings for a vector over all tables, about, and the most that a pair at the threshold is missed.
CHANCE, MISSED = 0.5, 0.001
#: Distinct vectors of a bucket that one side of a block pair holds at most (in the mean).
BLOCK = 1024


def usable() -> Column:
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & (F.size("embedding") > 0) & clean & F.exists("embedding", lambda x: x != 0)


def same_step(distance: float) -> float:
    """Probability that two vectors at a distance fall into one step of a direction."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Directions of a table and number of tables for so many distinct vectors in a label."""
    near, far = same_step(math.sqrt(2 - 2 * threshold)), same_step(math.sqrt(2))
    hashes, tables = 4, 1
    while True:
        tables = math.ceil(math.log(MISSED) / math.log(1 - near**hashes))
        if rows * tables * far**hashes <= CHANCE:
            return hashes, tables
        hashes += 1


def buckets(vectors: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """Bucket of each vector in each table, as 64-bit names.

    Components are rounded to 2**-20 and directions to 2**-10, so that every sum is exact, and a vector
    has the same names whatever other rows it is multiplied with.
    """
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    directions = np.rint(rng.standard_normal((vectors.shape[1], tables * hashes)) * 2**10) / 2**10
    shift = np.rint(rng.uniform(0, WIDTH, tables * hashes) * 2**10) / 2**10
    unit = vectors / np.abs(vectors).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.rint(unit * 2**20) / 2**20
    step = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, hashes)
    out = np.zeros(step.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(hashes):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + step[:, :, k], 1)
    return out.view(np.int64)


def posted(distinct: DataFrame, hashes: int, tables: int) -> DataFrame:
    """Rows (rep, t, key), one for each table: key is a 64-bit name of the label, the length, the table and the bucket."""

    def run(batches):
        for batch in batches:
            col = batch.column(2)
            cut = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
            rep, label, size = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), np.diff(cut)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                names = buckets(flat[cut[rows][:, None] + np.arange(n)], hashes, tables).view(np.uint64)
                with np.errstate(over="ignore"):
                    key = mix(names * np.uint64(0x9E3779B97F4A7C15) + mix(label[rows] + np.uint64(n), 2)[:, None] + np.arange(tables, dtype=np.uint64), 3)
                t = np.tile(np.arange(tables, dtype=np.int16), len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep[rows], tables)), pa.array(t), pa.array(key.view(np.int64).ravel())], ["rep", "t", "key"])

    return distinct.select("rep", F.xxhash64("label"), "embedding").mapInArrow(run, "rep bigint, t smallint, key bigint")


#: Rows of block pairs that one task group holds, about; vectors of a bucket up to which its pairs are listed instead of a matrix made.
CELL, LISTED = 4096, 48
#: Pairs that one numpy step holds.
STEP = 32_768


def listed(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) of rows inside each of some runs of rows."""
    row = ragged(begin, size)
    behind = np.repeat(begin + size, size) - row - 1  # rows of the same run that follow
    return np.repeat(row, behind), ragged(row + 1, behind)


def close_pairs(unit: np.ndarray, begin: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run whose cosine reaches the threshold; rows are of length 1."""
    few = size <= LISTED
    a, b = listed(begin[few], size[few])
    ok = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", unit[a[k : k + STEP]], unit[b[k : k + STEP]]) >= threshold for k in range(0, len(a), STEP))])
    found = [(a[ok], b[ok])]
    for k, m in zip(begin[~few], size[~few], strict=True):
        part = unit[k : k + m]
        x, y = np.nonzero(np.triu(part @ part.T >= threshold, 1))
        found.append((x + k, y + k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def compare(threshold: float, hashes: int, tables: int):
    """Cells of block pairs: for each vector how many linked ones it meets there first, and the least vector of its component there."""

    def run(held: pa.Table) -> pa.Table:
        col = held.column("embedding").combine_chunks()
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        cut = col.offsets.to_numpy()
        size, flat = np.diff(cut), col.values.to_numpy(zero_copy_only=False).astype(np.float64)
        number = lambda name: held.column(name).to_numpy()
        rep, many, t, own = number("rep"), number("many"), number("t"), number("own")
        label = held.column("label").combine_chunks().dictionary_encode()
        label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
        key = np.stack([number("key"), t, label, size, number("i"), number("j"), rep])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        edge = np.flatnonzero(np.r_[True, (key[:-1, 1:] != key[:-1, :-1]).any(0), True])
        a_of, b_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        width = size[order][edge[:-1]] if len(order) else edge[:0]
        for n in np.unique(width):
            runs = np.flatnonzero(width == n)
            begin, count = edge[runs], edge[runs + 1] - edge[runs]
            rows = order[ragged(begin, count)]
            x = flat[cut[rows][:, None] + np.arange(n)]
            x /= np.abs(x).max(1, keepdims=True)
            a, b = close_pairs(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], np.cumsum(count) - count, count, threshold)
            apart = (number("i")[rows[a]] == number("j")[rows[a]]) | (own[rows[a]] != own[rows[b]])
            a, b = a[apart], b[apart]
            # a pair counts in the first table in which the two meet
            used = np.unique(np.concatenate([a, b]))
            names = buckets(x[used], hashes, tables) if len(used) else np.zeros((0, tables), np.int64)
            first = np.zeros(len(a), bool)
            for k in range(0, len(a), STEP):
                p, q = (np.searchsorted(used, y[k : k + STEP]) for y in (a, b))
                first[k : k + STEP] = (names[p] == names[q]).argmax(1) == t[rows[a[k : k + STEP]]]
            a_of.append(rows[a[first]])
            b_of.append(rows[b[first]])
        a, b = np.concatenate(a_of), np.concatenate(b_of)
        held_reps, place = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
        p, q = place[: len(a)], place[len(a) :]
        found = np.bincount(p, many[b], len(held_reps)) + np.bincount(q, many[a], len(held_reps))
        least = np.arange(len(held_reps))
        while True:
            new = least.copy()
            np.minimum.at(new, p, least[q])
            np.minimum.at(new, q, least[p])
            new = new[new]
            if (new == least).all():
                break
            least = new
        return pa.table({"a": held_reps.astype(np.int64), "b": held_reps[least].astype(np.int64), "n": found.astype(np.int64)})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of all vectors (unique vec_id)."""
    rows = embeddings.select("vec_id", "label", "embedding")
    good = rows.where(usable() & F.col("vec_id").isNotNull())
    distinct = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    distinct = save(distinct)
    most = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    hashes, tables = plan(most, threshold)
    named = posted(distinct, hashes, tables)
    full = named.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("n_blocks", F.ceil(F.col("size") / BLOCK))
    with scratch(embeddings.sparkSession) as step:
        full = step.save(full)
        cells = (full.agg(F.sum(F.col("size") * F.col("n_blocks"))).first()[0] or 0) // CELL + 1
        placed = named.join(full, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n_blocks")))
        facing = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
        facing = facing.select("key", "t", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep")
        facing = facing.withColumn("cell", F.pmod(F.xxhash64("key", "i", "j"), F.lit(int(cells))))
        kind = distinct.schema["label"].dataType.simpleString()
        told_apart = F.to_json(F.struct("label")) if kind.startswith(("array", "struct")) else F.col("label")
        facing = facing.join(distinct.select("rep", "many", told_apart.alias("label"), "embedding"), "rep")
        found = save(facing.groupBy("cell").applyInArrow(compare(threshold, hashes, tables), "a bigint, b bigint, n bigint"))
    linked = found.groupBy("a").agg(F.sum("n").alias("others"))
    parts = components(found.select("a", "b"))
    known = distinct.join(linked, F.col("rep") == F.col("a"), "left").join(parts, F.col("rep") == F.col("node"), "left").select(
        "label", "embedding", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    done = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(usable() & F.col("vec_id").isNotNull(), F.lit(False)))
    rest = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), (F.col("vec_id") + F.lit(0)).alias("component_id"))
    return done.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_embedding_dedup: all embeddings, linked at a cosine of 0.98 within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.vec_id),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM m LEFT JOIN k ON x = vec_id
"""
