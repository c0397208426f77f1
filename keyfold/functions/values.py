"""Scalar functions over typed values.

A ``Value`` is a Column with a kind: bool, long, double, string or variant. Tabular
input has static kinds and its expressions stay native; a path into a raw JSON record is
a variant, and a function branches on the type inside only where it must. Every
function is total: a miss or a wrong type gives null, false, 0 or the empty string, as
its docstring says, and never an error (ANSI mode included).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest and least 64-bit integers.
MOST, LEAST = 2**63 - 1, -(2**63)
#: Formats of parse_time, each with the nanoseconds of its unit.
UNITS = {"epoch_seconds": 1_000_000_000, "epoch_millis": 1_000_000, "epoch_micros": 1_000, "epoch_nanos": 1}
#: Texts that stand for no value, compared without case, and one compared as it is.
UNKNOWN, NULL_TEXT = "unknown", "null"
NO_MEANING = rf"(?U)\A\s*({''.join(f'[{c}{c.upper()}]' for c in UNKNOWN)}|{NULL_TEXT})?\s*\z"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
LOCAL_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
INTEGER_TEXT = r"\A[+-]?[0-9]{1,18}\z"
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
KINDS = ("bool", "long", "double", "string", "variant")


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}; kinds: {', '.join(KINDS)}")


def lit(x: bool | int | float | str | None) -> Value:
    """A literal of its own kind; None is a null text."""
    for kind, types, name in (("bool", bool, "boolean"), ("long", int, "bigint"), ("double", float, "double")):
        if isinstance(x, types):
            return Value(F.lit(x).cast(name), kind)
    return Value(F.lit(x).cast("string"), "string")


def column(name: str, data_type: str) -> Value:
    """A column by name and Spark type (simple string)."""
    return column_of(F.col(name), data_type, name)


def column_of(c: Column, data_type: str, name: str = "") -> Value:
    """A Column of a Spark type (simple string)."""
    kinds = {"boolean": "bool", "tinyint": "long", "smallint": "long", "int": "long", "bigint": "long", "float": "double", "double": "double", "string": "string", "variant": "variant"}
    kind = kinds.get(data_type)
    if kind is None:
        raise ValueError(f"column {name}: no value kind for {data_type}")
    return Value(c.cast({"long": "bigint", "double": "double"}.get(kind, data_type)), kind)


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is evaluated once, however often f uses it; keeps nested expressions small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def once(f):
    """For functions of one value: a variant argument is evaluated once."""

    @wraps(f)
    def run(x: Value, *more):
        if x.kind != "variant":
            return f(x, *more)
        kind = []

        def inner(c: Column) -> Column:
            out = f(Value(c, "variant"), *more)
            kind.append(out.kind if isinstance(out, Value) else None)
            return out.col if isinstance(out, Value) else out

        col = bind(x.col, inner)
        return Value(col, kind[0]) if kind[0] else col

    return run


# ------------------------------------------------------------------ variants


def json_type(v: Column) -> Column:
    """Type inside a variant as Spark writes it (`BIGINT`, `DECIMAL(3,1)`, `OBJECT<...>`); null for SQL NULL."""
    return F.schema_of_variant(v)


def present(v: Column) -> Column:
    """A variant without the JSON null, which counts as missing."""
    return bind(v, lambda x: F.when(~F.is_variant_null(x), x))


def path(v: Column, dotted: str) -> Value:
    """A dotted path into a variant; no array indexing, a miss is null."""
    quoted = "".join(f'["{part}"]' for part in dotted.split("."))
    return Value(present(F.try_variant_get(v, f"${quoted}", "variant")), "variant")


#: Types of the numbers that a parsed JSON text or a cast can hold, besides DECIMAL(p,s).
NUMBERS = ("BIGINT", "DOUBLE", "INT", "SMALLINT", "TINYINT", "FLOAT")


def _is_number(v: Column) -> Column:
    return _number_type(json_type(v))


def _number_type(t: Column) -> Column:
    return t.isin(*NUMBERS) | t.startswith("DECIMAL")


@once
def strict_text(x: Value) -> Column:
    """The text if the value is a string, else null (numbers do not count)."""
    if x.kind == "variant":
        return F.when(json_type(x.col) == "STRING", F.try_variant_get(x.col, "$", "string"))
    return x.col if x.kind == "string" else F.lit(None).cast("string")


def _number_text(s: Column) -> Column:
    return bind(trim_white(s), lambda t: F.when(t.rlike(NUMBER_TEXT), t.try_cast("double")))


@once
def as_double(x: Value) -> Column:
    """Numeric view for comparisons: numbers, and finite numeric strings; else null."""
    if x.kind == "variant":
        return F.when(_is_number(x.col), F.try_variant_get(x.col, "$", "double")).otherwise(_number_text(strict_text(x)))
    if x.kind in ("long", "double"):
        return x.col.cast("double")
    return _number_text(x.col) if x.kind == "string" else F.lit(None).cast("double")


@once
def exact_long(x: Value) -> Column:
    """The integer that a value is or writes; null for fractions (whole ones too) and anything else."""
    if x.kind == "variant":
        whole, text = F.try_variant_get(x.col, "$", "bigint"), F.try_variant_get(x.col, "$", "string")
        return bind(json_type(x.col), lambda t: F.when(t == "BIGINT", whole).when(t == "STRING", trim_white(text).try_cast("bigint")))
    if x.kind == "string":
        return trim_white(x.col).try_cast("bigint")
    return x.col if x.kind == "long" else F.lit(None).cast("bigint")


def clamp(x: Column) -> Column:
    """A double as a 64-bit integer: cut off, saturating, NaN as 0."""
    return bind(x, _clamped)


def _clamped(d: Column) -> Column:
    return F.when(F.isnan(d), F.lit(0)).when(d >= float(MOST), F.lit(MOST)).when(d <= float(LEAST), F.lit(LEAST)).otherwise(d.try_cast("bigint"))


@once
def measure(x: Value) -> Column:
    """STRUCT<exact BIGINT, real DOUBLE, text STRING>: `exact_long`, `as_double` and `canonical` of a value, whose type is looked up once.

    A variant is read as the type that it has: asking for another one makes a cast for each value.
    """
    if x.kind != "variant":
        return F.struct(exact_long(x).alias("exact"), as_double(x).alias("real"), canonical(x).alias("text"))

    def held(exact: Column | None, real: Column | None, text: Column) -> Column:
        typed = ((exact, "bigint", "exact"), (real, "double", "real"), (text, "string", "text"))
        return F.struct(*((F.lit(None) if c is None else c).cast(kind).alias(n) for c, kind, n in typed))

    def of_text(s: Column) -> Column:
        # a plain integer needs no trimming, and its double is that of the integer
        plain = bind(s.try_cast("bigint"), lambda n: held(n, n, F.to_json(x.col)))
        other = bind(trim_white(s), lambda t: held(t.try_cast("bigint"), F.when(t.rlike(NUMBER_TEXT), t.try_cast("double")), F.to_json(x.col)))
        return F.when(s.rlike(INTEGER_TEXT), plain).otherwise(other)

    whole, real, text = (F.try_variant_get(x.col, "$", kind) for kind in ("bigint", "double", "string"))
    cases = lambda t: (
        F.when(t == "BIGINT", bind(whole, lambda n: held(n, n, n))).when(t == "STRING", bind(text, of_text))
        .when(_number_type(t), bind(real, lambda d: held(None, d, _shown(d)))).otherwise(held(None, None, F.when(t != "VOID", F.to_json(x.col))))
    )
    return bind(json_type(x.col), cases)


@once
def as_long(x: Value) -> Column:
    """Integer view: integers, floats cut off, numeric strings; else null."""
    if x.kind == "long":
        return x.col
    if x.kind == "double":
        return clamp(x.col)
    if x.kind == "string":
        return bind(trim_white(x.col), lambda t: F.coalesce(t.try_cast("bigint"), clamp(_number_text(t))))
    if x.kind == "variant":
        whole, number = F.try_variant_get(x.col, "$", "bigint"), F.try_variant_get(x.col, "$", "double")
        text = F.try_variant_get(x.col, "$", "string")
        return bind(json_type(x.col), lambda t: F.when(t == "BIGINT", whole).when(_number_type(t), clamp(number)).when(t == "STRING", as_long(Value(text, "string"))))
    return F.lit(None).cast("bigint")


# ------------------------------------------------------------------ predicates


@once
def truthy(x: Value) -> Column:
    """False for null, false, 0 and the empty string, else true ("0", [] and {} too)."""
    if x.kind == "bool":
        out = x.col
    elif x.kind in ("long", "double"):
        out = x.col != 0
    elif x.kind == "string":
        out = x.col != ""
    else:
        flag, text, number = (F.try_variant_get(x.col, "$", kind) for kind in ("boolean", "string", "double"))
        out = bind(json_type(x.col), lambda t: F.when(t == "BOOLEAN", flag).when(t == "STRING", text != "").when(_number_type(t), number != 0).otherwise(t != "VOID"))
    return F.coalesce(out, F.lit(False))


def both(a: Value, b: Value) -> Value:
    return Value(truthy(a) & truthy(b), "bool")


def either(a: Value, b: Value) -> Value:
    return Value(truthy(a) | truthy(b), "bool")


def negate(a: Value) -> Value:
    return Value(~truthy(a), "bool")


def equal(a: Value, b: Value) -> Value:
    """Numbers by value, the rest by structure, without coercion; two nulls are equal."""
    numeric = ("long", "double")
    if a.kind == b.kind and a.kind != "variant":
        out = a.col.eqNullSafe(b.col)
    elif a.kind in numeric and b.kind in numeric:
        out = a.col.cast("double").eqNullSafe(b.col.cast("double"))
    elif "variant" in (a.kind, b.kind):
        out = canonical(a).eqNullSafe(canonical(b))
    else:
        out = a.col.isNull() & b.col.isNull()
    return Value(out, "bool")


def unequal(a: Value, b: Value) -> Value:
    return Value(~equal(a, b).col, "bool")


@once
def canonical(x: Value) -> Column:
    """JSON text that equal values share; whole numbers print alike as integer and float."""
    if x.kind == "variant":
        real, other = F.try_variant_get(x.col, "$", "double"), F.when(~F.is_variant_null(x.col), F.to_json(x.col))
        return bind(json_type(x.col), lambda t: F.when(t == "BIGINT", F.to_json(x.col)).when(_number_type(t), bind(real, _shown)).otherwise(other))
    if x.kind == "string":
        return F.when(x.col.isNotNull(), F.regexp_extract(F.to_json(F.struct(x.col.alias("a"))), r'^\{"a":(.*)\}$', 1))
    return _shown(x.col) if x.kind == "double" else x.col.cast("string")


def _shown(d: Column) -> Column:
    """A double's text, a whole one's as of an integer."""
    return F.when((d == F.floor(d)) & (F.abs(d) < 2.0**53), d.try_cast("bigint").cast("string")).otherwise(d.cast("string"))


def compare(op: str, a: Value, b: Value) -> Value:
    """<, <=, > or >= on numeric views; false if either has none."""
    x, y = as_double(a), as_double(b)
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Value(F.coalesce(out, F.lit(False)), "bool")


def choose(condition: Value, then: Value, other: Value) -> Value:
    """One of two values by truthiness; values of different kinds meet as variants."""
    if then.kind == other.kind:
        return Value(F.when(truthy(condition), then.col).otherwise(other.col), then.kind)
    return Value(F.when(truthy(condition), to_variant(then)).otherwise(to_variant(other)), "variant")


def to_variant(x: Value) -> Column:
    return x.col if x.kind == "variant" else F.try_parse_json(canonical(x))


# ------------------------------------------------------------------ texts and numbers


def trim_white(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def trim(x: Value) -> Value:
    """Without white space around; anything but a string gives ''."""
    return Value(F.coalesce(trim_white(strict_text(x)), F.lit("")), "string")


def lower(x: Value) -> Value:
    """ASCII letters in lower case; anything but a string gives ''."""
    return Value(F.coalesce(F.translate(strict_text(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), "string")


@once
def meaningful(x: Value) -> Value:
    """The value unless it is null, blank, 'unknown' in any case or 'null'."""
    if x.kind not in ("string", "variant"):
        return x
    empty = strict_text(x).rlike(NO_MEANING)
    return Value(F.when(~F.coalesce(empty, F.lit(False)), present(x.col) if x.kind == "variant" else x.col), x.kind)


def coalesce(a: Value, b: Value) -> Value:
    """The first meaningful one of two."""
    x, y = meaningful(a), meaningful(b)
    if x.kind == y.kind:
        return Value(F.coalesce(x.col, y.col), x.kind)
    return Value(F.coalesce(to_variant(x), to_variant(y)), "variant")


def bucket(x: Value, width: Value) -> Value:
    """The value floored to a multiple of the width; a width of 0 or less changes nothing; null is 0."""
    v, w = F.coalesce(as_long(x), F.lit(0).cast("bigint")), F.coalesce(as_long(width), F.lit(0).cast("bigint"))
    floored = F.coalesce(F.try_subtract(v, F.pmod(v, F.when(w > 0, w))), F.lit(LEAST))
    return Value(F.when(w > 0, floored).otherwise(v), "long")


@once
def round_even(x: Value) -> Value:
    """Half to even, saturating; numeric strings count; anything else is 0."""
    if x.kind == "long":
        return Value(F.coalesce(x.col, F.lit(0).cast("bigint")), "long")
    exact = F.when(json_type(x.col) == "BIGINT", F.try_variant_get(x.col, "$", "bigint")) if x.kind == "variant" else F.lit(None).cast("bigint")
    return Value(F.coalesce(exact, clamp(F.rint(as_double(x))), F.lit(0).cast("bigint")), "long")


def concat(*parts: Value) -> Value:
    """Texts of at least two parts joined; null, arrays and objects are empty."""
    if len(parts) < 2:
        raise ValueError("concat takes at least two parts")
    return Value(F.concat(*(F.coalesce(as_text(p), F.lit("")) for p in parts)), "string")


@once
def as_text(x: Value) -> Column:
    """A scalar's text: strings, numbers and booleans."""
    if x.kind == "variant":
        text = F.try_variant_get(x.col, "$", "string")
        return bind(json_type(x.col), lambda t: F.when(t == "STRING", text).when(_number_type(t) | (t == "BOOLEAN"), F.to_json(x.col)))
    return x.col.cast("string")


@once
def key_text(x: Value) -> Column:
    """A key: a meaningful string as it is, or a number's text; else null."""
    if x.kind == "variant":
        text = F.try_variant_get(x.col, "$", "string")
        return bind(json_type(x.col), lambda t: F.when(t == "STRING", meaningful(Value(text, "string")).col).when(_number_type(t), F.to_json(x.col)))
    if x.kind == "string":
        return meaningful(x).col
    return x.col.cast("string") if x.kind in ("long", "double") else F.lit(None).cast("string")


def get(x: Value, dotted: str) -> Value:
    """A dotted path inside a variant; null for anything else."""
    return path(x.col, dotted) if x.kind == "variant" else Value(F.lit(None).cast("variant"), "variant")


def parse_json(x: Value) -> Value:
    """A string's JSON value; null if it is none."""
    return Value(present(F.try_parse_json(strict_text(x))), "variant")


def _iso_nanos(s: Column) -> Column:
    return bind(trim_white(s), _trimmed_nanos)


def _trimmed_nanos(t: Column) -> Column:
    zoned = t.rlike(RFC3339)
    whole = F.regexp_replace(F.upper(t), r"\.\d+", "")
    local = t.rlike(LOCAL_ISO)
    at = F.when(zoned, whole.try_cast("timestamp")).when(local, F.concat(t, F.lit("Z")).try_cast("timestamp"))
    fraction = F.rpad(F.substring(F.regexp_extract(t, r"\.(\d+)", 1), 1, 9), 9, "0").try_cast("bigint")
    nanos = F.try_multiply(F.unix_seconds(at), F.lit(1_000_000_000).cast("bigint"))
    return F.try_add(nanos, F.when(zoned, F.coalesce(fraction, F.lit(0))).otherwise(F.lit(0)))


@once
def parse_time(x: Value, unit: str | None = None) -> Value:
    """Epoch nanoseconds.

    Without a unit a number counts as it is, and a string as a number or an
    RFC 3339 time (without an offset only to the second, as UTC). With a unit of UNITS
    numbers are scaled, null on overflow; 'rfc3339' takes strings only.
    """
    if unit is None:
        if x.kind in ("long", "double"):
            return Value(as_long(x), "long")
        text = strict_text(x)
        number = as_long(x) if x.kind != "bool" else F.lit(None).cast("bigint")
        return Value(F.coalesce(number, _iso_nanos(text)), "long")
    if unit == "rfc3339":
        return Value(_iso_nanos(strict_text(x)), "long")
    if unit not in UNITS:
        raise ValueError(f"unknown time format {unit!r}; formats: rfc3339, {', '.join(UNITS)}")
    return Value(F.try_multiply(as_long(x), F.lit(UNITS[unit]).cast("bigint")), "long")
