"""Reducers over the collections of a state.

A collection is a grow-only map column (MAP<STRING, STRUCT<comparator BIGINT, payload>>)
or an array of payloads. ``field`` takes a payload and gives a part of it: a Value (such as
``lambda p: v.path(p, "price")`` for a VARIANT payload, where numeric texts count as numbers) or a typed
Column (``lambda p: p["price"]``). Where several reducers read one field, ``measured`` reads it once for all of them. Maps are read in key order, as they are stored. Where the
collection is null: list and filter give [], sum and count_distinct 0, the others null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyfold.functions import values as v
from keyfold.functions.values import Value

Field = Callable[[Column], "Column | Value"]


def by_key(entries: Column) -> Column:
    """Entries in key order (the comparison looks at keys only: payloads may have no order)."""
    return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def sorted_entries(m: Column) -> Column:
    return by_key(F.map_entries(m))


def payloads(m: Column) -> Column:
    return F.transform(sorted_entries(m), lambda e: e["value"]["payload"])


@dataclass(frozen=True)
class Measured:
    """A field of an item of `measured`: read once, its number and its canonical text beside it."""

    item: Column

    @property
    def col(self) -> Column:
        return self.item["value"]


def measured(items: Column, field: Callable[[Column], Value]) -> Column:
    """The items as STRUCT<item, value, number>; reducers over them take `Measured` as their field and give what they give for `items` and `field` (items: `item` inside)."""

    def held(p: Column, x: Value) -> Column:
        return F.struct(p.alias("item"), x.col.alias("value"), v.measure(x).alias("number"))

    def read(p: Column) -> Column:
        x = field(p)
        return v.bind(x.col, lambda c: held(p, Value(c, x.kind)))

    return F.transform(items, read)


def _column(x: Column | Value | Measured) -> Column:
    return x.col if isinstance(x, Value | Measured) else x


def _number(x: Column | Value | Measured) -> Column:
    """STRUCT<exact BIGINT, real DOUBLE, ...> of a value: integers and integer texts are exact, other numbers and texts real."""
    if isinstance(x, Measured):
        return x.item["number"]
    if not isinstance(x, Value):  # a typed column of a kind that is not known here
        x = Value(x.cast("string"), "string")
    return v.measure(x) if x.kind == "variant" else F.struct(v.exact_long(x).alias("exact"), v.as_double(x).alias("real"))


def _pick(items: Column, rank: Field, greatest: bool) -> Column:
    """The item with the greatest or least rank; what is no number does not count; the first of equals stays.

    Two integers are compared as such, so that times in nanoseconds keep their last digits.
    """
    def better(x: Column, y: Column) -> Column:
        exact = x["exact"].isNotNull() & y["exact"].isNotNull()
        if greatest:
            return F.when(exact, x["exact"] > y["exact"]).otherwise(x["real"] > y["real"])
        return F.when(exact, x["exact"] < y["exact"]).otherwise(x["real"] < y["real"])

    def best(held: Column) -> Column:
        takes = lambda a, x: x["real"].isNotNull() & (a["real"].isNull() | better(x, a))
        return F.aggregate(held, F.get(held, F.lit(-1)), lambda a, x: F.when(takes(a["number"], x["number"]), x).otherwise(a))

    if rank is Measured:
        return best(items)
    return v.bind(F.transform(items, lambda x: F.struct(_number(rank(x)).alias("number"), x.alias("item"))), best)["item"]


def _comparator(e: Column) -> Value:
    return Value(F.coalesce(e["value"]["comparator"], F.lit(0).cast("bigint")), "long")


def latest(m: Column) -> Column:
    """Payload of the greatest comparator of a map (missing: 0); equal ones: the first in key order."""
    return _pick(sorted_entries(m), _comparator, True)["value"]["payload"]


def first(m: Column) -> Column:
    """Payload of the least comparator of a map, likewise."""
    return _pick(sorted_entries(m), _comparator, False)["value"]["payload"]


def latest_by(items: Column, field: Field) -> Column:
    """The item with the greatest numeric field."""
    return _pick(items, field, True)


def first_by(items: Column, field: Field) -> Column:
    return _pick(items, field, False)


def list_of(items: Column) -> Column:
    return F.coalesce(items, F.array())


def count(collection: Column) -> Column:
    """Entries of a map or array; null for null."""
    return F.when(collection.isNotNull(), F.size(collection).cast("bigint"))


_WIDE = "decimal(38,0)"


def _wide_sum(items: Column, integer: Field) -> Column:
    """Exact sum of 64-bit integers; more than 10**18 of them would be needed to leave 38 digits."""
    return F.aggregate(items, F.lit(0).cast(_WIDE), lambda a, x: F.coalesce(F.try_add(a, integer(x).cast("decimal(19,0)")).cast(_WIDE), a))


def total(items: Column, field: Field) -> Value:
    """Sum as a VARIANT: an integer if all numbers are integers (or texts of such) and the sum fits in 64 bits, else a double.

    What is no number is skipped; nothing gives 0.
    """
    numbers = F.transform(items, lambda p: _number(field(p)))

    def parts(held: Column) -> Column:
        """Each part of the sum once: what follows reads them several times."""
        rest = F.aggregate(held, F.lit(0.0), lambda a, s: a + F.when(s["exact"].isNull(), F.coalesce(s["real"], F.lit(0.0))).otherwise(F.lit(0.0)))
        mixed = F.exists(held, lambda s: s["exact"].isNull() & s["real"].isNotNull())
        return F.struct(_wide_sum(held, lambda s: s["exact"]).alias("whole"), rest.alias("rest"), mixed.alias("mixed"))

    def summed(s: Column) -> Column:
        exact = F.when(~s["mixed"] & s["whole"].between(v.LEAST, v.MOST), s["whole"]).try_cast("bigint")
        return F.when(exact.isNotNull(), exact.cast("variant")).otherwise((s["whole"].cast("double") + s["rest"]).cast("variant"))

    return Value(v.bind(v.bind(F.coalesce(numbers, F.array()), parts), summed), "variant")


def total_long(items: Column, field: Field) -> Column:
    """Sum of a typed integer field, saturating; nulls are skipped, nothing gives 0."""
    least, most = (F.lit(x).cast(_WIDE) for x in (v.LEAST, v.MOST))
    return F.greatest(least, F.least(most, F.coalesce(_wide_sum(items, lambda p: _column(field(p))), F.lit(0).cast(_WIDE)))).cast("bigint")


def total_double(items: Column, field: Field) -> Column:
    return F.coalesce(F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(_column(field(x)).cast("double"), F.lit(0.0))), F.lit(0.0))


def least(items: Column, field: Field) -> Column:
    """The least field; of Values the least number, as it stands."""
    return _extreme(items, field, False)


def greatest(items: Column, field: Field) -> Column:
    return _extreme(items, field, True)


def _extreme(items: Column, field: Field, most: bool) -> Column:
    kind: list[str | None] = []

    def part(p: Column) -> Column:
        x = field(p)
        kind.append(x.kind if isinstance(x, Value) else "measured" if isinstance(x, Measured) else None)
        return _column(x)

    held = F.transform(items, part)
    if kind[-1] == "measured":
        return _pick(items, Measured, most)["value"]
    if kind[-1] in ("variant", "string"):
        return _pick(held, lambda c: Value(c, kind[-1]), most)
    return (F.array_max if most else F.array_min)(F.filter(held, lambda c: c.isNotNull()))


def only(items: Column, test: Field) -> Column:
    """Payloads that pass the test (a boolean Column, or a Value that counts by its truth)."""
    return F.coalesce(F.filter(items, lambda p: v.truthy(x) if isinstance(x := test(p), Value) else x), F.array())


def count_distinct(items: Column, field: Field) -> Column:
    """Exact distinct non-null values of a field; 1 and 1.0 are one value, 1 and "1" are two."""
    part = lambda p: v.canonical(x) if isinstance(x := field(p), Value) else x.item["number"]["text"] if isinstance(x, Measured) else x
    return F.coalesce(F.size(F.array_distinct(F.filter(F.transform(items, part), lambda c: c.isNotNull()))), F.lit(0)).cast("bigint")
