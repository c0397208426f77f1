"""Admission and keying of records.

Records come as a DataFrame of events: either raw (a JSON text column, read as a VARIANT) or
tabular (typed columns). Every record gets a tag: admitted, filtered, or (raw only)
malformed, and admitted ones a ``session_key``. All of it is narrow: no shuffle, and
filters on typed columns reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyfold.functions import values as v
from keyfold.functions.values import Value

from .made import once
from .schema import Accept, Schema, alternatives, key_segments

ADMITTED, FILTERED, MALFORMED = "admitted", "filtered", "malformed"


@dataclass(frozen=True)
class Record:
    """Scope of one event: paths into its VARIANT, or its columns."""

    schema: StructType | None = None
    variant: str | None = None

    def __getitem__(self, dotted: str) -> Value:
        """The value at a dotted path; a miss is null."""
        if self.variant:
            return v.path(F.col(self.variant), dotted)
        kind = self.schema
        for part in dotted.split("."):
            if not isinstance(kind, StructType) or part not in kind.names:
                return v.lit(None)
            kind = kind[part].dataType
        return v.column(dotted, kind.simpleString())

    def root(self) -> Column:
        """The whole record."""
        if self.variant:
            return F.col(self.variant)
        return F.struct(*self.schema.names)

    def first_text(self, source: str) -> Column:
        """The first of `a|b|c` that is a string."""
        return F.coalesce(*(v.strict_text(self[p]) for p in alternatives(source)), F.lit(None).cast("string"))


def admit(accept: Accept, record: Record) -> Column:
    """Whether a record is admitted; never null.

    A required entry takes its first alternative that is a string and fails if that
    one is empty: later alternatives are not tried.
    """
    out = F.lit(True)
    for source in accept.require:
        text = record.first_text(source)
        out &= F.coalesce(text != "", F.lit(False))
        if accept.reject_if_contains:
            out &= ~F.coalesce(F.contains(text, F.lit(accept.reject_if_contains)), F.lit(False))
    for allowed, source in ((accept.event_types, accept.event_type_path), (accept.tenants, accept.tenant_path)):
        if allowed:
            out &= F.coalesce(record.first_text(source).isin(*allowed), F.lit(False))
    return out


def session_key(template: str, record: Record) -> Column:
    """The key of a record; null where a hole finds no string (an empty one is allowed)."""
    return F.concat(*(F.lit(s) if isinstance(s, str) else record.first_text("|".join(s)) for s in key_segments(template)))


def parse_records(raw: DataFrame, payload: str = "value", into: str = "record") -> DataFrame:
    """Adds the record VARIANT of a JSON payload column; null where it is malformed.

    Spark's parser accepts text after the first JSON value; such a payload is malformed
    here. A document with a duplicate key is malformed too. The record comes out of a generator of one row,
    so that a filter on what is read from it does not parse the text once more below.
    """
    text = v.trim_white(F.col(payload).cast("string"))
    # parsed once, as the first of two values in brackets; the second one, which no text can know, stands where the text has ended its value and the brackets have not
    last = F.xxhash64(payload)
    values = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), last.cast("string"), F.lit("]"))).try_cast("array<variant>")

    def first(held: Column) -> Column:
        closed = (F.size(held) == 2) & (F.try_variant_get(F.get(held, F.lit(1)), "$", "bigint") == last)
        return F.when(closed, F.get(held, F.lit(0)))

    return _made_once(raw.drop(into), into, v.bind(values, first))


def _made_once(rows: DataFrame, name: str, c: Column) -> DataFrame:
    """Rows with a column that later filters read instead of computing it again."""
    return rows.select("*", F.explode(F.array(c)).alias(name))


def tag(events: DataFrame, schema: Schema, variant: str | None = None, made: dict | None = None) -> DataFrame:
    """Adds `tag` and `session_key` to every event; `variant` names a raw record's column."""

    def build() -> dict[str, Column]:
        record = Record(None, variant) if variant else Record(events.schema)
        key = F.when(admit(schema.accept, record), session_key(schema.primary_key, record))
        label = F.when(F.col("session_key").isNotNull(), ADMITTED).otherwise(FILTERED)
        if variant:
            label = F.when(F.col(variant).isNull(), MALFORMED).otherwise(label)
        return {"session_key": key, "tag": label}

    held = once(made, "tag", build)
    return events.withColumns({"session_key": held["session_key"]}).withColumns({"tag": held["tag"]})


def admitted(events: DataFrame, schema: Schema, variant: str | None = None) -> DataFrame:
    """The admitted events with their `session_key`."""
    if variant:
        record = Record(None, variant)
        key = F.when(admit(schema.accept, record), session_key(schema.primary_key, record))
        return _made_once(events.drop("session_key"), "session_key", key).where("session_key IS NOT NULL")
    record = Record(events.schema)  # of typed columns: these filters reach the scan
    kept = events.where(admit(schema.accept, record)).withColumn("session_key", session_key(schema.primary_key, record))
    return kept.where("session_key IS NOT NULL")
