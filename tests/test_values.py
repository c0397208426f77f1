"""Scalar functions: one table of expressions and results."""

import pytest
from pyspark.sql import functions as F

from keyfold.functions import values as v

L = v.lit


def json_value(text):
    return v.Value(v.present(F.try_parse_json(F.lit(text))), "variant")


def cases():
    none = v.lit(None)
    return [
        (v.meaningful(L(" Unknown ")), None), (v.meaningful(L("null")), None), (v.meaningful(L("NULL")), "NULL"), (v.meaningful(L("  ")), None), (v.meaningful(L(" x ")), " x "), (v.meaningful(L(0)), 0),
        (v.round_even(L(2.5)), 2), (v.round_even(L(3.5)), 4), (v.round_even(L(-0.5)), 0), (v.round_even(none), 0), (v.round_even(L("2.5")), 2), (v.round_even(json_value("21.5")), 22),
        (v.bucket(L(-7), L(5)), -10), (v.bucket(L(7), L(0)), 7), (v.bucket(none, L(5)), 0), (v.bucket(L(v.LEAST), L(7)), v.LEAST),
        (v.trim(L(5)), ""), (v.trim(L("　 a\t")), "a"), (v.lower(L("ÄB")), "Äb"), (v.lower(L(5)), ""),
        (v.equal(L("5"), L(5)), False), (v.compare(">=", L("5"), L(5)), True), (v.equal(none, none), True), (v.equal(L(1), L(1.0)), True), (v.equal(json_value("1.0"), L(1)), True),
        (v.equal(json_value('"a"'), L("a")), True), (v.equal(json_value("null"), none), True), (v.equal(json_value('"5"'), L(5)), False), (v.unequal(L("a"), L("b")), True),
        (v.compare("<", L("a"), L(1)), False), (v.compare("<", L("NaN"), L(1)), False), (v.negate(none), True), (v.both(L("0"), L(True)), True), (v.either(L(""), L(0)), False),
        (v.concat(L("a"), L(1), L(True), none), "a1true"), (v.concat(L("a"), json_value("[1]")), "a"), (v.choose(L("x"), L(1), L(2)), 1), (v.choose(none, L(1), L(2)), 2),
        (v.parse_time(L("2024-06-01T00:00:00")), 1717200000000000000), (v.parse_time(L("2024-06-01T00:00:00.5")), None), (v.parse_time(L("2024-06-01T00:00:00Z")), 1717200000000000000),
        (v.parse_time(L("2024-06-01T05:30:00.123456789+05:30")), 1717200000123456789), (v.parse_time(L(5), "epoch_seconds"), 5000000000), (v.parse_time(L(2**62), "epoch_seconds"), None),
        (v.parse_time(L("5"), "rfc3339"), None), (v.parse_time(L("12")), 12), (v.parse_time(json_value("1717207200")), 1717207200), (v.parse_time(L(True)), None),
        (v.coalesce(L("unknown"), L("b")), "b"), (v.coalesce(none, none), None), (v.get(json_value('{"a":{"b":7}}'), "a.b"), "7"), (v.get(L("x"), "a"), None), (v.parse_json(L("{bad")), None),
        (v.Value(v.key_text(L(7)), "string"), "7"), (v.Value(v.key_text(L(" unknown")), "string"), None), (v.Value(v.key_text(json_value("7")), "string"), "7"), (v.Value(v.key_text(json_value("[7]")), "string"), None),
        (v.Value(v.as_long(L("5.9")), "long"), 5), (v.Value(v.as_long(L(1e30)), "long"), v.MOST), (v.Value(v.as_long(L(float("nan"))), "long"), 0), (v.Value(v.as_long(json_value("9223372036854775807")), "long"), v.MOST),
        (v.Value(v.truthy(json_value("[]")), "bool"), True), (v.Value(v.truthy(json_value("0")), "bool"), False), (v.Value(v.truthy(json_value('""')), "bool"), False), (v.Value(v.truthy(json_value("null")), "bool"), False),
    ]


def test_table(spark):
    wanted = cases()
    shown = [F.to_json(x.col) if x.kind == "variant" else x.col for x, _ in wanted]
    found = []
    for k in range(0, len(shown), 8):  # small plans
        found += list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(shown[k : k + 8]))).first())
    assert [(k, x) for k, (x, (_, want)) in enumerate(zip(found, wanted, strict=True)) if x != want] == []


def test_errors(spark):
    with pytest.raises(ValueError):
        v.parse_time(L(1), "bad")
    with pytest.raises(ValueError):
        v.concat(L("a"))
    with pytest.raises(ValueError):
        v.Value(F.lit(1), "date")
