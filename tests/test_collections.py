from pyspark.sql import functions as F

from keyfold.functions import collections as c
from keyfold.functions import values as v

SCHEMA = "id int, m map<string,struct<comparator:bigint,payload:struct<f:bigint,s:string>>>"


def test_reducers(spark):
    rows = [
        (1, {"b": (5, (3, "x")), "a": (5, (1, "y")), "c": (1, (None, "x"))}),
        (2, {}),
        (3, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("items", c.payloads(F.col("m")))
    f, items = (lambda p: p["f"]), F.col("items")
    found = df.select(
        c.latest(F.col("m"))["s"], c.first(F.col("m"))["s"], c.latest_by(items, f)["s"], c.first_by(items, f)["s"], F.size(c.list_of(items)), c.count(F.col("m")), c.total_long(items, f),
        c.least(items, f), c.greatest(items, f), F.size(c.only(items, lambda p: p["s"] == "x")), c.count_distinct(items, f), c.total_double(items, f),
    ).collect()
    assert [tuple(r) for r in found] == [
        ("y", "x", "x", "y", 3, 3, 4, 1, 3, 2, 2, 4.0),  # equal comparators: the first in key order
        (None, None, None, None, 0, 0, 0, None, None, 0, 0, 0.0),
        (None, None, None, None, 0, None, 0, None, None, 0, 0, 0.0),
    ]


def test_reducers_over_json(spark):
    """Numeric texts count, integers stay exact, 1 and 1.0 are one value."""
    cases = {
        "[1,2,3]": ("6", "1", "3", 3), '["1",2,"x",null]': ("3", '"1"', "2", 3), "[1.6,1.6]": ("3.2", "1.6", "1.6", 1), "[1,1.0,true,\"1\"]": ("3.0", "1", "1", 3),
        "[9223372036854775807,9223372036854775807]": ("1.8446744073709552E19", "9223372036854775807", "9223372036854775807", 1), "[9223372036854775807,-1]": ("9223372036854775806", "-1", "9223372036854775807", 2),
        "[1700000000000000001,1700000000000000002]": ("3400000000000000003", "1700000000000000001", "1700000000000000002", 2), "[]": ("0", None, None, 0), '["a"]': ("0", None, None, 1),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("items", F.try_parse_json("t").try_cast("array<variant>"))
    field = lambda p: v.Value(v.present(p), "variant")
    items = F.col("items")
    rows = df.select("t", F.to_json(c.total(items, field).col), F.to_json(c.least(items, field)), F.to_json(c.greatest(items, field)), c.count_distinct(items, field)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == cases
    only = df.where("t LIKE '%x%'").select(F.to_json(c.only(items, lambda p: v.compare(">", field(p), v.lit(1))))).first()[0]
    assert only == "[2]"
    doubles = spark.createDataFrame([([1.6, 1.6],), ([2.0, None],), (None,)], "a array<double>").select(F.to_json(c.total(F.col("a"), lambda x: x).col)).collect()
    assert [r[0] for r in doubles] == ["3.2", "2.0", "0"]
    longs = spark.createDataFrame([([v.MOST, v.MOST],), ([v.LEAST, -5],)], "a array<bigint>").select(c.total_long(F.col("a"), lambda x: x)).collect()
    assert [r[0] for r in longs] == [v.MOST, v.LEAST]


def test_measured_fields(spark):
    """Reducers over measured items give what they give for the items; a field is read once for all of them."""
    cases = ['[{"a":1},{"a":"7"},{"a":" 8 "},{"a":2.5},{}]', '[{"a":9007199254740993},{"a":"9007199254740992"}]', '[{"a":3},{"a":3.0},{"a":"3"},{"a":"-0"}]', '[{"a":true},{"a":"x"},{"a":[1]},{"a":null},{"a":"1\\u2028"}]', "[]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").withColumn("items", F.try_parse_json("t").try_cast("array<variant>"))
    field = lambda p: v.path(p, "a")

    def reduced(items, f, whole):
        picked = (c.least(items, f), c.greatest(items, f), whole(c.latest_by(items, f)), whole(c.first_by(items, f)))
        return [F.to_json(x) for x in (c.total(items, f).col, *picked)] + [c.count_distinct(items, f)]

    plain = df.select("i", *reduced(F.col("items"), field, lambda x: x))
    shared = df.select("i", c.measured(F.col("items"), field).alias("items")).select("i", *reduced(F.col("items"), c.Measured, lambda x: x["item"]))
    rows = [tuple(r) for r in shared.orderBy("i").collect()]
    assert rows == [tuple(r) for r in plain.orderBy("i").collect()]
    assert rows[0][1:4] == ("18.5", "1", '" 8 "') and rows[1][1:4] == ("18014398509481985", '"9007199254740992"', "9007199254740993") and rows[3][1:4] == ("1", '"1 "', '"1 "')
