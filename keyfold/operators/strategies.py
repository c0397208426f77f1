"""Merge strategies: how a field of a state grows from events.

A ``Strategy`` says what one event adds, how the events of a batch are combined (an aggregate with
a partial step), how that meets the stored value, and what counts as nothing. Subclass it for
a strategy of your own; the fold and the merge know no other interface.

State columns: latest_by STRUCT<comparator BIGINT, payload>, grouped_map MAP<STRING, STRUCT<...>>,
last_seen and write_once the value, counter BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyfold.functions import values as v
from keyfold.functions.collections import by_key, sorted_entries
from keyfold.functions.values import Value

#: scope -> Value
Expr = Callable[["object"], Value]


class Strategy:
    """The strategy of one field. `when`, if set, gates what an event adds."""

    when: Expr | None = None

    def gate(self, record) -> Column:
        return F.lit(True) if self.when is None else v.truthy(self.when(record))

    def adds(self, record) -> Column:
        """What one event adds."""
        raise NotImplementedError

    def combined(self, added: Column, seq: Column) -> Column:
        """An aggregate over what the events of a session add; seq is their arrival order."""
        raise NotImplementedError

    def merged(self, stored: Column, local: Column) -> Column:
        """The stored (older) and the local (newer) value as one; both may be null."""
        raise NotImplementedError

    def kept(self, state: Column) -> Column:
        """The value, null where it says nothing."""
        return state

    def problems(self) -> list[str]:
        return []


def newer(stored: Column, local: Column) -> Column:
    """Of two latest-by slots the greater comparator; of equal ones the local, newer one."""
    return F.when(stored.isNull() | (local["comparator"] >= stored["comparator"]), F.coalesce(local, stored)).otherwise(F.coalesce(stored, local))


def idle(slot: Column) -> Column:
    return (slot["comparator"] == 0) & slot["payload"].isNull()


@dataclass(frozen=True)
class LatestBy(Strategy):
    """The payload with the greatest comparator; of equal ones the newer.

    It takes part with {0, null} for a record that its gate turns away: such a record, if
    newer, erases a payload whose comparator is 0 or less. That is the defined result.
    """

    comparator: Expr
    payload: Expr | None = None
    when: Expr | None = None

    def rank(self, record) -> Column:
        """Nanoseconds or any integer; 0 where it does not parse."""
        return F.coalesce(v.parse_time(self.comparator(record)).col, F.lit(0).cast("bigint"))

    def held(self, record) -> Column:
        return record.root() if self.payload is None else self.payload(record).col

    def adds(self, record) -> Column:
        gate = self.gate(record)
        return F.struct(F.when(gate, self.rank(record)).otherwise(F.lit(0).cast("bigint")).alias("comparator"), F.when(gate, self.held(record)).alias("payload"))

    def combined(self, added: Column, seq: Column) -> Column:
        return F.max_by(added, F.struct(added["comparator"], seq))

    def merged(self, stored: Column, local: Column) -> Column:
        return newer(stored, local)

    def kept(self, state: Column) -> Column:
        return F.when(~idle(state), state)


@dataclass(frozen=True)
class GroupedMap(Strategy):
    """A growing map: each key has a latest-by slot of its own. The fold combines it entry by entry."""

    key: Expr
    value: LatestBy
    when: Expr | None = None

    def adds(self, record) -> Column:
        entry = F.when(self.gate(record), v.key_text(self.key(record)))
        return F.struct(entry.alias("entry"), self.value.rank(record).alias("comparator"), self.value.held(record).alias("payload"))

    def collected(self, entries: Column) -> Column:
        """An aggregate: the (key, value) structs of a session's entries as a map in key order."""
        return F.map_from_entries(by_key(F.collect_list(entries)))

    def merged(self, stored: Column, local: Column) -> Column:
        both = F.map_from_entries(sorted_entries(F.map_zip_with(stored, local, lambda _, a, b: newer(a, b))))
        return F.when(stored.isNull(), local).when(local.isNull(), stored).otherwise(both)

    def kept(self, state: Column) -> Column:
        return F.when(state.isNotNull(), F.map_filter(state, lambda _, slot: ~idle(slot)))

    def problems(self) -> list[str]:
        if not isinstance(self.value, LatestBy):
            return ["a grouped map holds latest-by slots only"]
        return ["the inner slot must not have a gate of its own"] if self.value.when is not None else []


@dataclass(frozen=True)
class LastSeen(Strategy):
    """The last meaningful value by arrival."""

    value: Expr
    when: Expr | None = None

    def adds(self, record) -> Column:
        return F.when(self.gate(record), v.meaningful(self.value(record)).col)

    def combined(self, added: Column, seq: Column) -> Column:
        return F.max_by(added, F.when(added.isNotNull(), seq))

    def merged(self, stored: Column, local: Column) -> Column:
        return F.coalesce(local, stored)


@dataclass(frozen=True)
class WriteOnce(Strategy):
    """The first meaningful value, kept for good."""

    value: Expr
    when: Expr | None = None

    def adds(self, record) -> Column:
        return F.when(self.gate(record), v.meaningful(self.value(record)).col)

    def combined(self, added: Column, seq: Column) -> Column:
        return F.min_by(added, F.when(added.isNotNull(), seq))

    def merged(self, stored: Column, local: Column) -> Column:
        return F.coalesce(stored, local)


@dataclass(frozen=True)
class Counter(Strategy):
    """Admitted records (that pass the gate), saturating."""

    when: Expr | None = None

    def adds(self, record) -> Column:
        return self.gate(record)

    def combined(self, added: Column, seq: Column) -> Column:
        return F.count_if(added)

    def merged(self, stored: Column, local: Column) -> Column:
        nothing = F.lit(0).cast("bigint")
        return F.coalesce(F.try_add(F.coalesce(stored, nothing), F.coalesce(local, nothing)), F.lit(v.MOST))

    def kept(self, state: Column) -> Column:
        return F.when(state != 0, state)
