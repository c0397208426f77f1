"""State transitions as signed change deltas.

Each output stream turns (old, new) states into -1 and +1 rows: a gate that opens
emits +1 rows, one that closes -1 rows, one that stays open a pair for each changed row
of the new state. Rows are paired inside their own session by map key or array
place, so that a transition needs no shuffle: one generator over the entries, then
one over at most two legs.

Rows that only the old state has are not retracted while the gate stays open (states only
grow). An unchanged row (columns and key) is silent. A row whose configured key is not
a meaningful scalar is invisible. Retention looks at the new row of a pair, and at
its own row for a lone leg.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from keyfold.functions import values as v
from keyfold.functions.values import Value

from .enrich import lookup
from .made import once
from .schema import Retention, Schema, Stream, Transformer


class NoEntry(ValueError):
    """An expression asks for an exploded entry where there is none, as in a gate."""


@dataclass(frozen=True)
class State:
    """Scope of an output expression: a state, and the entry of an exploded row."""

    base: str
    schema: StructType
    element: str | None = None
    variant_lookups: bool = False

    def __getitem__(self, name: str) -> Column:
        """A field of the state, as a Column."""
        return F.col(f"{self.base}.{name}")

    def value(self, dotted: str) -> Value:
        """A typed value at a dotted path of the state; inside a VARIANT the path goes on."""
        return _typed(F.col(self.base), self.schema, dotted)

    def each(self, dotted: str) -> Value:
        """A typed value of the exploded entry (`payload.x`, `comparator`)."""
        if self.element is None:
            raise NoEntry("only a row of an exploded field has an entry")
        return _typed(F.col(self.element), self.entry_type, dotted)

    def lookup(self, name: str) -> Value:
        """The value that the stream's look-up of that name found; null for none."""
        c = F.col(f"{self.base}_lookup_{name}")
        return Value(v.present(c), "variant") if self.variant_lookups else Value(c.cast("string"), "string")

    @property
    def entry_type(self):
        return self.schema["#entry"].dataType if "#entry" in self.schema.names else None


def _typed(c: Column, kind, dotted: str) -> Value:
    parts = dotted.split(".")
    while parts and isinstance(kind, StructType):
        if parts[0] not in kind.names:
            return v.lit(None)
        c, kind = c[parts[0]], kind[parts.pop(0)].dataType
    name = kind.simpleString()
    if name == "variant":
        return v.path(c, ".".join(parts)) if parts else Value(v.present(c), "variant")
    if parts:
        return v.lit(None)
    kinds = {"boolean": "bool", "tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "float": "double", "double": "double", "string": "string"}
    if name not in kinds:
        raise ValueError(f"{dotted}: a {name} is no scalar; use scope[...] for collections")
    return Value(c.cast({"long": "bigint", "double": "double"}.get(kinds[name], name)), kinds[name])


def _column(x) -> Column:
    return x.col if isinstance(x, Value) else x


def _fields(stream: Stream, scope: State) -> dict[str, Column]:
    """Projected columns by name; where common and row share one, the row's counts unless it is null."""
    out = {n: _column(f(scope)) for n, f in stream.common.items()}
    for n, f in (stream.each if stream.explode else stream.columns).items():
        c = _column(f(scope))
        out[n] = F.coalesce(c, out[n]) if n in out else c
    return dict(sorted(out.items()))


def _key(stream: Stream, scope: State) -> Column:
    """'' without a configured key; null where it is not a meaningful scalar."""
    if stream.key is None:
        return F.lit("")
    x = stream.key(scope)
    return v.key_text(x) if isinstance(x, Value) else x


def _seconds(retention: Retention, row: Column, kinds: dict) -> Column:
    """Epoch seconds of a row's timestamp; null where the row has none."""
    head, _, rest = retention.timestamp_field.partition(".")
    if head not in kinds:
        return F.lit(None).cast("bigint")
    kind, c = kinds[head].simpleString(), row[head]
    if kind == "variant":
        number = v.as_long(v.path(c, rest) if rest else v.Value(v.present(c), "variant"))
    elif not rest and kind in ("bigint", "int", "smallint", "tinyint", "string"):
        number = v.as_long(v.column_of(c, kind))
    elif not rest and kind in ("double", "float"):
        number = v.as_long(v.column_of(F.when(~F.isnan(c), c), kind))
    else:
        number = v.as_long(v.path(F.try_parse_json(F.to_json(F.struct(c.alias("at")))), f"at.{rest}" if rest else "at"))
    cut = F.when(number >= 0, F.floor(number / 1000)).otherwise(F.ceil(number / 1000)).cast("bigint")
    return number if retention.unit == "seconds" else cut


def _kept(stream: Stream, row: Column, kinds: dict, now: Column) -> Column:
    """Rows younger than the retention; a row without the timestamp stays."""
    if stream.retention is None:
        return F.lit(True)
    at = _seconds(stream.retention, row, kinds)
    return F.coalesce(now - at < stream.retention.days * 86400, F.lit(True))


def _payload(stream: Stream, row: Column, names, sign: int) -> Column:
    """JSON with sorted names, nulls left out."""
    held = {n: row[n] for n in names}
    if stream.sign_flag:
        held["sign_flag"] = F.lit(sign)
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(held.items())))) if held else F.lit("{}")


def length_prefixed(*parts: Column) -> Column:
    """One text from which the parts can be told apart."""
    return F.concat(*(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def fnv128_rows(texts: list[bytes]) -> list[str]:
    """FNV-1a with 128 bits of each text, all rows one byte further at a time.

    The prime is 2**88 + 0x13B, so that a step is a shift and a small product; a hash is held as
    two 64-bit halves.
    """
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = (np.cumsum(size) - size)[order]
    high, low = np.full(len(texts), 0x6C62272E07BB0142, np.uint64), np.full(len(texts), 0x62B821756295C58D, np.uint64)
    alive = len(texts) - np.searchsorted(np.sort(size), np.arange(int(size.max(initial=0))), "right")
    small, half = np.uint64(0x13B), np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        for k, n in enumerate(alive):
            x = low[:n] ^ flat[begin[:n] + k]
            carry = ((x >> np.uint64(32)) * small + ((x & half) * small >> np.uint64(32))) >> np.uint64(32)
            high[:n] = high[:n] * small + carry + (x << np.uint64(24))
            low[:n] = x * small
    out = np.empty(len(texts), object)
    out[order] = [f"{h:016x}{w:016x}" for h, w in zip(high.tolist(), low.tolist(), strict=True)]
    return out.tolist()


@F.pandas_udf(StringType())
def fnv128(parts: pd.Series) -> pd.Series:
    """FNV-1a with 128 bits over parts, each after its byte length as a little-endian 64-bit integer."""
    raw = [[t.encode() for t in texts] for texts in parts]
    return pd.Series(fnv128_rows([b"".join(len(t).to_bytes(8, "little") + t for t in texts) for texts in raw]))


def _ids(stream: Stream, exact: bool, row_id: Column, payload: Column, *more: Column) -> Column:
    cause = [F.coalesce(F.col(f"causation_{c}").cast("string"), F.lit("")) for c in ("topic", "partition", "offset")]
    parts = [F.lit(stream.name), F.lit(stream.topic), F.col("session_key"), *cause, row_id, payload, *more]
    return fnv128(F.array(*parts)) if exact else F.md5(length_prefixed(*parts))


def render(states: DataFrame, stream: Stream, now: Column | int, exact_ids: bool = False, enrichment: DataFrame | None = None, made: dict | None = None) -> DataFrame:
    """Deltas (stream, topic, key, payload, sign, session_key, row_id, event_id, correlation_id, causation_*) of one stream.

    `states` has session_key, old and new (structs of equal type; old is null for a new session), and,
    if known, causation_topic, causation_partition and causation_offset. `enrichment` has (table, key, value),
    value a VARIANT or a text; both legs of a pair read what it holds now. `made` keeps the columns
    for the next batch of the same kind.
    """
    kind = states.schema["new"].dataType
    own = lambda key, build: once(made, (stream.name, key), build)
    cause = {f"causation_{c}": t for c, t in (("topic", "string"), ("partition", "int"), ("offset", "bigint"))}
    rows = states.withColumns({n: F.lit(None).cast(t) for n, t in cause.items() if n not in states.columns} | {"now": F.lit(now) if isinstance(now, int) else now})
    variants = enrichment is not None and enrichment.schema["value"].dataType.simpleString() == "variant"
    old, new = (State(base, kind, variant_lookups=variants) for base in ("old", "new"))
    rows, later = _looked_up(rows, stream, enrichment, old, new, own)
    rows = rows.withColumns(own("gates", lambda: _gates(stream, old, new))).where("old_open OR new_open")
    if stream.explode is not None:
        shape = kind[stream.explode].dataType
        wide = StructType([*kind.fields]).add("#entry", shape.valueType if isinstance(shape, MapType) else shape.elementType)
        old, new = (replace(s, schema=wide, element=f"{s.base}_each") for s in (old, new))
        for step in own("entries", lambda: _entries(stream.explode, isinstance(shape, MapType))):
            rows = rows.withColumns(step)
        rows, _ = _looked_up(rows, stream, enrichment, old, new, own, later)
    else:
        rows = rows.withColumns({"row_id": F.lit(""), "in_old": F.col("old_open"), "in_new": F.col("new_open")})
    rows = rows.withColumns(own("fields", lambda: _projected(stream, old, new)))
    rows = rows.withColumns(own("legs", lambda: _legs(stream, rows.schema["after"].dataType)))
    rows = rows.select("session_key", "row_id", *cause, own("inline", lambda: F.inline(_picked())))
    return rows.select(
        F.lit(stream.name).alias("stream"), F.lit(stream.topic).alias("topic"), "key", "payload", "sign", "session_key", "row_id", *own(("ids", exact_ids), lambda: _named(stream, exact_ids)), *cause
    )


def _looked_up(rows: DataFrame, stream: Stream, enrichment: DataFrame | None, old: State, new: State, own, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Rows with the look-ups whose keys the scopes can give, and the names of those that need an exploded entry."""
    later = []
    if enrichment is None:
        return rows, later
    for name, (table, key) in stream.lookups.items():
        if names is not None and name not in names:
            continue
        try:
            keys = own(("look-up", name), lambda: [(s.base, key(s)) for s in (new, old)])  # noqa: B023
        except NoEntry:
            later.append(name)
            continue
        for base, at in keys:
            rows = lookup(rows, enrichment, table, at, f"{base}_lookup_{name}")
    return rows, later


def _gates(stream: Stream, old: State, new: State) -> dict[str, Column]:
    is_open = lambda scope: F.lit(True) if stream.gate is None else v.truthy(stream.gate(scope))
    return {"old_open": F.col("old").isNotNull() & is_open(old), "new_open": is_open(new)}


def _entries(name: str, is_map: bool) -> list[dict[str, Column]]:
    """Steps that give a row for each entry of the new state (of the old one where the gate closes), paired with the old state's."""
    held, was = F.col(f"new.{name}"), F.col(f"old.{name}")
    if is_map:
        ids, at, known = F.map_keys, F.try_element_at, F.map_contains_key
    else:
        ids = lambda m: F.transform(m, lambda _, i: i.cast("string"))
        at = lambda m, k: F.try_element_at(m, k.cast("int") + 1)
        known = lambda m, k: F.size(m) > k.cast("int")
    row = F.col("row_id")
    paired = {
        "in_new": F.col("new_open"),
        "in_old": F.col("old_open") & F.coalesce(known(was, row), F.lit(False)),
        "new_each": F.when(F.col("new_open"), at(held, row)),
        "old_each": at(was, row),
    }
    return [{"row_id": F.explode(F.when(F.col("new_open"), ids(held)).otherwise(ids(was)))}, paired]


def _projected(stream: Stream, old: State, new: State) -> dict[str, Column]:
    pack = lambda held: F.struct(*(c.alias(n) for n, c in held.items())) if held else F.struct(F.lit(0).alias("_"))
    return {"after": pack(_fields(stream, new)), "before": pack(_fields(stream, old)), "new_key": _key(stream, new), "old_key": _key(stream, old)}


def _legs(stream: Stream, row: StructType) -> dict[str, Column]:
    """Payloads of both legs and whether retention lets them go; as_plus is the old row under the sign of the new one, to tell a change."""
    kinds = {f.name: f.dataType for f in row.fields if f.name != "_"}
    a, b, names = F.col("after"), F.col("before"), list(kinds)
    was = F.col("in_old") & F.col("old_key").isNotNull()
    return {
        "plus": F.when(F.col("in_new") & F.col("new_key").isNotNull(), _payload(stream, a, names, 1)),
        "minus": F.when(was, _payload(stream, b, names, -1)),
        "plus_kept": _kept(stream, a, kinds, F.col("now")),
        "minus_kept": _kept(stream, b, kinds, F.col("now")),
        "as_plus": F.when(was, _payload(stream, b, names, 1)),
    }


def _picked() -> Column:
    """The legs that a row gives, -1 before +1."""
    plus, minus = F.col("plus").isNotNull(), F.col("minus").isNotNull()
    same = F.col("plus").eqNullSafe(F.col("as_plus")) & F.col("new_key").eqNullSafe(F.col("old_key"))

    def leg(sign: int, key: str, payload: str, anchor: str) -> Column:
        return F.struct(F.lit(sign).alias("sign"), F.col(key).alias("key"), F.col(payload).alias("payload"), F.col(anchor).alias("anchor"))

    pair = F.array(leg(-1, "old_key", "minus", "plus"), leg(1, "new_key", "plus", "plus"))
    return (
        F.when(plus & minus & ~same & F.col("plus_kept"), pair)
        .when(plus & ~minus & F.col("plus_kept"), F.array(leg(1, "new_key", "plus", "plus")))
        .when(minus & ~plus & F.col("minus_kept"), F.array(leg(-1, "old_key", "minus", "minus")))
    )


def _named(stream: Stream, exact: bool) -> list[Column]:
    signed = F.when(F.col("sign") > 0, "+1").otherwise("-1")
    return [
        _ids(stream, exact, F.col("row_id"), F.col("payload"), signed).alias("event_id"),
        _ids(stream, exact, F.col("row_id"), F.col("anchor")).alias("correlation_id"),
    ]


def deltas(states: DataFrame, transformer: Transformer, now: Column | int, exact_ids: bool = False, enrichment: DataFrame | None = None, made: dict | None = None) -> DataFrame:
    """The deltas of all streams (of whatever projections the transformer holds)."""
    out = None
    for stream in transformer.streams:
        part = render(states, stream, now, exact_ids, enrichment, made) if isinstance(stream, Stream) else stream.deltas(states, now, enrichment)
        out = part if out is None else out.unionByName(part)
    return out


def validate(states: DataFrame, transformer: Transformer, enrichment: DataFrame | None = None) -> list[str]:
    """All that Spark's analyzer has against the streams, stream by stream; no state is read."""
    return [f"[stream {s.name}] {what}" for s in transformer.streams for what in _analyzed(states, s, enrichment)]


def _analyzed(states: DataFrame, stream, enrichment: DataFrame | None) -> list[str]:
    """Each expression of a stream by itself first, so that one fault does not hide another; then the whole."""
    found = []
    if isinstance(stream, Stream):
        plain = replace(stream, columns={}, each={}, common={}, key=None, gate=None, retention=None)
        row = "each" if stream.explode else "columns"
        parts = [(f"{kind} {n}", replace(plain, **{kind: {n: f}})) for kind in ("common", row) for n, f in getattr(stream, kind).items()]
        parts += [(kind, replace(plain, **{kind: getattr(stream, kind)})) for kind in ("gate", "key") if getattr(stream, kind) is not None]
        found = [f"{what}: {e}" for what, part in parts if (e := _error(states, part, enrichment))]
    return found or [e for e in [_error(states, stream, enrichment)] if e]


def _error(states: DataFrame, stream, enrichment: DataFrame | None) -> str:
    try:
        stream.deltas(states, 0, enrichment).schema  # noqa: B018
    except Exception as e:  # noqa: BLE001  every kind of analysis error is a finding
        return str(e).splitlines()[0]
    return ""


def check(schema: Schema, transformer: Transformer, states: DataFrame, enrichment: DataFrame | None = None) -> list[str]:
    """Findings about the transformer against a state, all in one pass: unknown fields and tables, explodes of what is no field."""
    tables = {r[0] for r in enrichment.select("table").distinct().collect()} if enrichment is not None else set()
    wrong, sound = [], []
    for s in transformer.streams:
        lost = [f"[stream {s.name}] look-up {n}: no table {t}" for n, (t, _) in s.lookups.items() if t not in tables]
        no_field = bool(getattr(s, "explode", None)) and s.explode not in schema.fields
        lost += [f"[stream {s.name}] explode: {s.explode} is not a field of the state"] * no_field
        wrong += lost
        if not lost:
            sound.append(s)
    return wrong + [f"[stream {s.name}] {what}" for s in sound for what in _analyzed(states, s, enrichment)]
