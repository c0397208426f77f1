"""Enrichment: left-outer lookups in small keyed tables.

A dimension is a DataFrame (table STRING, key STRING, value). A lookup is an equi-join;
the side of one table is broadcast only while it has at most BROADCAST_ROWS rows and BROADCAST_BYTES
of keys and values, beyond that Spark joins by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions import values as v

BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def is_small(side: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows and, written as JSON, so many bytes."""
    found = side.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint")), F.lit(0))).first()
    return found[0] <= rows and found[1] <= size


def lookup(rows: DataFrame, dimension: DataFrame, table: str, key: v.Value, into: str) -> DataFrame:
    """Adds the value of `table` at `key`; a miss, or a key that is no meaningful scalar, is null.

    Keys are unique in a table; of several values one counts.
    """
    side = dimension.where(F.col("table") == table).groupBy("key").agg(F.first("value").alias(into)).withColumnRenamed("key", "_lookup")
    if is_small(side):
        side = F.broadcast(side)
    return rows.withColumn("_lookup", v.key_text(key)).join(side, "_lookup", "left").drop("_lookup")
