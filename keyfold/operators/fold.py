"""Grouped fold of admitted events into one state row for each session.

An event becomes one row for the plain fields and one for each map entry that it touches. Rows are
aggregated by (session, field, entry), with a partial step before the shuffle, so that a hot session
is combined where it is read and spreads over its entries; a second aggregate gathers a
session's fields, which are the size of the state itself. They are dealt out by session as plain rows: an entry
is one row by then, so that a partial step would only pack and sort it. The input is read once. A single map field and
nothing else takes one row for each event. Without map fields one aggregate by session does.

Arrival order is the column `seq` (anything orderable, unique in a session).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import Record
from .made import once
from .schema import Schema
from .strategies import GroupedMap


def contributions(events: DataFrame, schema: Schema, record: Record, made: dict | None = None) -> DataFrame:
    """One row for each event: session_key, seq, and what it adds to each field."""
    added = once(made, "adds", lambda: [s.adds(record).alias(n) for n, s in schema.fields.items()])
    return events.select("session_key", "seq", *added)


def fold(events: DataFrame, schema: Schema, variant: str | None = None, also: dict[str, Column] | None = None, made: dict | None = None) -> DataFrame:
    """One row for each session of admitted events with `session_key` and `seq`: the local state.

    A latest_by that nothing was admitted to is {0, null} here, since it still has to meet
    the stored one; `elided` removes it. An empty map is null. `also` names more aggregates over
    the events of a session (of `seq`), which follow the fields. `made` keeps the columns for the
    next batch of the same kind.
    """
    record = Record(None, variant) if variant else Record(events.schema)
    each, also = contributions(events, schema, record, made), also or {}
    maps = [n for n, s in schema.fields.items() if isinstance(s, GroupedMap)]
    plain = once(made, "plain", lambda: {n: s.combined(F.col(n), F.col("seq")) for n, s in schema.fields.items() if n not in maps}) | also
    aggregates = [c.alias(n) for n, c in plain.items()]
    if not maps:
        return each.groupBy("session_key").agg(*(aggregates or [F.count(F.lit(1)).alias("_n")])).select("session_key", *plain)
    kinds = {n: each.schema[n].dataType["payload"].dataType.simpleString() for n in maps}
    payloads = {kind: f"payload_{k}" for k, kind in enumerate(dict.fromkeys(kinds.values()))}

    def slot(name: str | None) -> Column:
        """A row of the exploded event: of one map field, or (None) of the plain ones."""
        at = (lambda part: F.col(f"{name}.{part}")) if name else (lambda part: F.lit(None))
        held = [(at("payload") if name and kinds[name] == kind else F.lit(None)).cast(kind).alias(p) for kind, p in payloads.items()]
        return F.struct(F.lit(name).cast("string").alias("field"), at("entry").cast("string").alias("entry"), at("comparator").cast("bigint").alias("comparator"), *held)

    own = [n for n in schema.fields if n not in maps]
    if len(maps) == 1 and not plain:  # an event without an entry still makes its session known
        rows = each.select("session_key", "seq", F.lit(maps[0]).alias("field"), *(F.col(f"{maps[0]}.{c}").alias(n) for c, n in (("entry", "entry"), ("comparator", "comparator"), ("payload", "payload_0"))))
    else:
        slots = once(made, "slots", lambda: F.inline(F.array(slot(None), *map(slot, maps))))
        rows = each.select("session_key", "seq", *own, slots).where("field IS NULL OR entry IS NOT NULL")
        rows = rows.withColumns(once(made, "own", lambda: {n: F.when(F.col("field").isNull(), F.col(n)) for n in own}))
    best = once(made, "best", lambda: [F.max("comparator").alias("comparator"), *(F.max_by(p, F.struct("comparator", "seq")).alias(p) for p in payloads.values())])
    parts = rows.groupBy("session_key", "field", "entry").agg(*aggregates, *best).repartition("session_key")

    def collected(name: str) -> Column:
        entry = F.struct(F.col("entry").alias("key"), F.struct("comparator", F.col(payloads[kinds[name]]).alias("payload")).alias("value"))
        return schema.fields[name].collected(F.when((F.col("field") == name) & F.col("entry").isNotNull(), entry)).alias(name)

    one = [F.first(F.when(F.col("field").isNull(), F.struct(*plain)), ignorenulls=True).alias("plain")] if plain else []
    out = parts.groupBy("session_key").agg(*one, *once(made, "maps", lambda: [collected(n) for n in maps]))
    named = {n: F.when(F.size(n) > 0, F.col(n)) if n in maps else F.col(f"plain.{n}") for n in [*schema.fields, *also]}
    return out.select("session_key", *(c.alias(n) for n, c in named.items()))


def elided(state: DataFrame, schema: Schema) -> DataFrame:
    """Fields that say nothing as null: {0, null} slots (in maps too), a count of 0."""
    return state.select("session_key", *(s.kept(F.col(n)).alias(n) for n, s in schema.fields.items()))


def merge(stored: DataFrame, local: DataFrame, schema: Schema, made: dict | None = None) -> DataFrame:
    """Rows (session_key, old STRUCT, new STRUCT) of the sessions of `local`; other columns of `local` follow.

    `stored` is the elided state before (old is null for a new session); `new` is the
    elided state after.
    """
    names = list(schema.fields)
    more = [n for n in local.columns if n not in ("session_key", *names)]
    before = stored.select("session_key", F.struct(*names).alias("old"))
    after = local.select("session_key", F.struct(*names).alias("local"), *more).join(before, "session_key", "left")
    new = once(made, "new", lambda: F.struct(*(s.kept(s.merged(F.col(f"old.{n}"), F.col(f"local.{n}"))).alias(n) for n, s in schema.fields.items())))
    return after.select("session_key", "old", new.alias("new"), *more)
