"""The enrichment file: JSON, {table: {key: value}}, reloaded when it is older than a period."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (table, key, value VARIANT); a file of another shape is an error."""
    text = spark.read.text(path, wholetext=True)
    tables = text.select(F.explode_outer(F.try_parse_json("value").try_cast("map<string,variant>")).alias("table", "held"))
    rows = tables.select("table", F.explode_outer(F.col("held").try_cast("map<string,variant>")).alias("key", "value"), F.schema_of_variant("held").alias("shape"))
    bad = rows.where("table IS NULL OR shape NOT LIKE 'OBJECT%'").limit(1).count()
    if bad:
        raise ValueError(f"enrichment {path}: the root and each table must be objects")
    return rows.where("key IS NOT NULL").select("table", "key", "value")


@dataclass
class Enrichment:
    """Keeps the last good content; a reload that fails or loses a table changes nothing."""

    spark: SparkSession
    path: str
    reload_secs: float = 43_200
    clock: object = time.monotonic
    _rows: DataFrame | None = field(default=None, init=False)
    _tables: frozenset[str] = field(default=frozenset(), init=False)
    _at: float = field(default=0.0, init=False)

    def rows(self) -> DataFrame:
        if self._rows is None:
            self._load()
        elif self.clock() - self._at >= self.reload_secs:
            try:
                self._load()
            except Exception:  # noqa: BLE001  whatever is wrong with the new file, the old content stays
                self._at = self.clock()
        return self._rows

    def tables(self) -> frozenset[str]:
        self.rows()
        return self._tables

    def _load(self) -> None:
        rows = read(self.spark, self.path)
        names = frozenset(r[0] for r in rows.select("table").distinct().collect())
        if not names >= self._tables:
            raise ValueError(f"enrichment {self.path}: tables are missing: {sorted(self._tables - names)}")
        self._rows, self._tables, self._at = rows, names, self.clock()
