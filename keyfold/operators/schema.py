"""Declarations of a session state and of output streams.

Expressions are functions from a scope to a ``Value`` (or a Column with a kind), written with
``keyfold.functions``; Spark's analyzer checks them. Nothing here parses text but the
``{a|b}`` key template and ``a|b`` alternatives.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from .strategies import Counter, Expr, GroupedMap, LastSeen, LatestBy, Strategy, WriteOnce

__all__ = [
    "Accept", "Counter", "Expr", "GroupedMap", "LastSeen", "LatestBy", "Projection", "Retention", "Schema", "SchemaError", "Strategy", "Stream", "Transformer", "WriteOnce",
    "alternatives", "key_segments",
]


class SchemaError(ValueError):
    """Everything that is wrong with a declaration, in one message."""


def alternatives(source: str) -> list[str]:
    """`a|b|c`, trimmed, empty ones dropped."""
    return [p for p in (part.strip() for part in source.split("|")) if p]


def key_segments(template: str) -> list[str | list[str]]:
    """Literals (str) and holes (lists of alternatives); an unbalanced brace is a literal."""
    out: list[str | list[str]] = []
    for text, hole in re.findall(r"([^{]+|\{(?![^}]*\}))|\{([^}]*)\}", template):
        if text:
            out.append(text)
        elif found := alternatives(hole):
            out.append(found)
        else:
            raise SchemaError(f"{template!r}: the braces name no path, so that no record could have a key (empty hole)")
    return out


@dataclass(frozen=True)
class Accept:
    """Admission: required paths, a token they must not contain, event types, tenants."""

    require: tuple[str, ...] = ()
    reject_if_contains: str | None = None
    event_types: tuple[str, ...] = ()
    event_type_path: str = "log_type"
    tenants: tuple[str, ...] = ()
    tenant_path: str = "log.tenant_id"


@dataclass(frozen=True)
class Schema:
    aggregate: str
    version: int
    id_type: str
    primary_key: str
    fields: dict[str, Strategy]
    accept: Accept = field(default_factory=Accept)

    def __post_init__(self) -> None:
        wrong = []
        if not self.aggregate:
            wrong.append("aggregate name must not be empty")
        try:
            key_segments(self.primary_key)
        except SchemaError as e:
            wrong.append(str(e))
        for name, strategy in self.fields.items():
            if not isinstance(strategy, Strategy):
                wrong.append(f"field {name}: {type(strategy).__name__} is no strategy (a state has one level)")
            else:
                wrong += [f"field {name}: {what}" for what in strategy.problems()]
        if wrong:
            raise SchemaError(f"[schema {self.aggregate}] " + "; ".join(wrong))


@dataclass(frozen=True)
class Retention:
    """Rows older than so many days by a projected column (a dotted path into it allowed) are not emitted."""

    days: int
    timestamp_field: str
    unit: str = "seconds"


@dataclass(frozen=True)
class Stream:
    """An output stream: gate, one row (columns) or a row for each entry (explode, each), key, retention.

    `lookups` names values of enrichment tables, (table, key expression); columns, key and gate read them
    with `scope.lookup(name)`. A gate reads those whose key comes from the state alone, not from the
    exploded entry.
    """

    name: str
    topic: str
    columns: dict[str, Expr] = field(default_factory=dict)
    each: dict[str, Expr] = field(default_factory=dict)
    common: dict[str, Expr] = field(default_factory=dict)
    explode: str | None = None
    gate: Expr | None = None
    key: Expr | None = None
    retention: Retention | None = None
    sign_flag: bool = True
    lookups: dict[str, tuple[str, Expr]] = field(default_factory=dict)

    def deltas(self, states, now, enrichment=None, exact_ids: bool = False):
        from .transition import render

        return render(states, self, now, exact_ids, enrichment)

    def problems(self) -> list[str]:
        row = self.each if self.explode else self.columns
        retention = self.retention
        checks = [
            (not self.name, "needs a non-empty name"),
            (not self.topic, "topic must not be empty"),
            (bool(self.columns) and bool(self.explode or self.each), "use either columns (one row) or explode and each (a row for each entry)"),
            (bool(self.each) and not self.explode, "each needs explode"),
            (retention is not None and (retention.days <= 0 or not retention.timestamp_field), "retention needs days > 0 and a timestamp_field"),
            (retention is not None and retention.unit not in ("seconds", "millis"), "retention unit is seconds or millis"),
            (self.sign_flag and ("sign_flag" in self.common or "sign_flag" in row), "the name sign_flag is reserved while sign_flag is on"),
        ]
        return [f"[stream {self.name}] {what}" for failed, what in checks if failed]


class Projection(Protocol):
    """What a transformer holds: a Stream, or anything of your own that turns states into deltas.

    `deltas(states, now, enrichment)` gets rows (session_key, old, new, causation_*) and gives
    the columns that `transition.render` gives.
    """

    name: str
    topic: str
    lookups: dict

    def problems(self) -> list[str]: ...

    def deltas(self, states, now, enrichment=None): ...


@dataclass(frozen=True)
class Transformer:
    streams: tuple[Projection, ...]
    version: int = 1

    def __post_init__(self) -> None:
        names = [s.name for s in self.streams]
        wrong = [p for s in self.streams for p in s.problems()]
        wrong += [f"duplicate stream name {n!r}" for n in sorted({n for n in names if names.count(n) > 1})]
        if self.version <= 0:
            wrong.append("transformer version must be over 0")
        if wrong:
            raise SchemaError("; ".join(wrong))
