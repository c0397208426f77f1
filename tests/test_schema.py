import pytest

from keyfold.functions import values as v
from keyfold.operators.schema import Counter, GroupedMap, LatestBy, Retention, Schema, SchemaError, Stream, Transformer, key_segments

ONE = lambda r: v.lit(1)


def test_key_segments():
    assert key_segments("{a|b}-{c}") == [["a", "b"], "-", ["c"]]
    assert key_segments("x{a") == ["x", "{", "a"]
    with pytest.raises(SchemaError):
        key_segments("{ | }")


def test_schema_errors_in_one_pass():
    inner = LatestBy(ONE, when=ONE)
    with pytest.raises(SchemaError) as e:
        Schema("", 1, "t", "{}", {"a": GroupedMap(ONE, inner), "b": GroupedMap(ONE, Counter()), "c": {"x": Counter()}})
    for part in ("aggregate name", "empty hole", "field a", "field b", "field c"):
        assert part in str(e.value)


@pytest.mark.parametrize(
    "stream",
    [
        Stream("s", ""), Stream("", "t"), Stream("s", "t", columns={"a": ONE}, explode="m"), Stream("s", "t", each={"a": ONE}), Stream("s", "t", retention=Retention(0, "a")),
        Stream("s", "t", retention=Retention(1, "a", "hours")), Stream("s", "t", columns={"sign_flag": ONE}),
    ],
)
def test_stream_errors(stream):
    with pytest.raises(SchemaError):
        Transformer((stream,))


def test_duplicate_names():
    with pytest.raises(SchemaError):
        Transformer((Stream("s", "a"), Stream("s", "b")))
