"""Fold and merge: edge rows, laws, and cuts into batches."""

from pyspark.sql import functions as F

from keyfold.functions import values as v
from keyfold.operators import fold, ingest
from keyfold.operators.schema import Counter, GroupedMap, LastSeen, LatestBy, Schema, Strategy, WriteOnce

SLOT = LatestBy(comparator=lambda r: r["c"], payload=lambda r: r["p"])
SCHEMA = Schema("t", 1, "t", "{k}", {
    "slot": LatestBy(comparator=lambda r: r["c"], payload=lambda r: r["p"], when=lambda r: r["g"]),
    "once": WriteOnce(value=lambda r: r["p"]), "last": LastSeen(value=lambda r: r["p"]), "n": Counter(when=lambda r: r["g"]),
    "m": GroupedMap(key=lambda r: r["e"], value=SLOT, when=lambda r: r["g"]),
})


def local(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, k string, g boolean, c string, p string, e string")
    return fold.fold(ingest.admitted(df, SCHEMA), SCHEMA)


def slot(spark, rows):
    r = fold.elided(local(spark, [("k", g, c, p, "e") for g, c, p in rows]), SCHEMA).first()
    return r["slot"] and r["slot"]["payload"]


def test_latest_by_edges(spark):
    assert slot(spark, [(True, "5", "A"), (True, "5", "B")]) == "B"
    assert slot(spark, [(True, "9", "A"), (True, "5", "B")]) == "A"
    assert slot(spark, [(True, "zz", "A"), (False, "1", "X")]) is None  # erased
    assert slot(spark, [(False, "1", "X"), (True, "0", "A")]) == "A"
    assert slot(spark, [(True, "-5", "A"), (False, "1", "X")]) is None  # erased
    assert slot(spark, [(True, "-5", "A")]) == "A"


def test_once_last_counter_map(spark):
    rows = [("k", True, "1", "unknown", "a"), ("k", True, "2", "a", "b"), ("k", False, "9", "b", "a"), ("k", True, "3", "", "a"), ("k", True, "3", None, "null")]
    r = fold.elided(local(spark, rows), SCHEMA).first()
    assert (r["once"], r["last"], r["n"]) == ("a", "b", 4)
    assert {k: (s["comparator"], s["payload"]) for k, s in r["m"].items()} == {"a": (3, ""), "b": (2, "a")}


def test_merge_equals_one_fold(spark, tmp_path):
    """Positive comparators: however the events are cut into batches, the state is the same."""
    rows = [(f"k{i % 3}", i % 4 != 0, str(10 + i * 7 % 11), f"p{i}", f"e{i % 2}") for i in range(24)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, k string, g boolean, c string, p string, e string")
    names = list(SCHEMA.fields)
    text = lambda d: sorted(r[0] for r in d.select(F.to_json(F.struct("session_key", *names))).collect())
    at = iter(range(100))
    whole = fold.elided(fold.fold(ingest.admitted(df, SCHEMA), SCHEMA), SCHEMA)
    for cuts in ([0, 12, 24], [0, 3, 5, 17, 24]):
        state = whole.where("false")
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = fold.fold(ingest.admitted(df.where(f"seq >= {a} AND seq < {b}"), SCHEMA), SCHEMA)
            done = fold.merge(state, part, SCHEMA).select("session_key", "new.*")
            path = f"{tmp_path}/{next(at)}"  # through Parquet, as the state table goes
            done.union(state.join(done, "session_key", "left_anti")).write.parquet(path)
            state = spark.read.schema(whole.schema).parquet(path)
        assert text(state) == text(whole)


def test_counter_saturates(spark):
    big = spark.range(1).select(Counter().merged(F.lit(v.MOST), F.lit(5)).alias("n"))
    assert big.first()["n"] == v.MOST


def test_a_strategy_of_ones_own(spark):
    """A field with a strategy that the library does not know: the longest text."""

    class Longest(Strategy):
        def adds(self, record):
            return record["p"].col

        def combined(self, added, seq):
            return F.max_by(added, F.struct(F.length(added), seq))

        def merged(self, stored, local):
            return F.when(F.length(stored) > F.coalesce(F.length(local), F.lit(0)), stored).otherwise(local)

    schema = Schema("t", 1, "t", "{k}", {"longest": Longest(), "m": SCHEMA.fields["m"]})
    df = spark.createDataFrame([(i, "k", True, "1", p, "e") for i, p in enumerate(["a", "ccc", None, "bb"])], "seq int, k string, g boolean, c string, p string, e string")
    parts = [fold.fold(ingest.admitted(df.where(w), schema), schema) for w in ("seq < 2", "seq >= 2")]
    assert [p.first()["longest"] for p in parts] == ["ccc", "bb"]
    assert fold.merge(fold.elided(parts[0], schema), parts[1], schema).first()["new"]["longest"] == "ccc"
    assert fold.fold(ingest.admitted(df, schema), schema, also={"last": F.max("seq")}).first()["last"] == 3


def test_admission_edges(spark):
    from keyfold.plans.parcels import SCHEMA as parcel

    base = '"kind":"scanned","network":"north"'
    cases = {
        "": "malformed", "{bad": "malformed", '{"a":1} x': "malformed", "5": "filtered", "[]": "filtered", "{}": "filtered",
        f'{{{base},"parcel":"","scan":{{"parcel":"p"}}}}': "filtered", f'{{{base},"parcel":7,"scan":{{"parcel":"p"}}}}': "admitted", f'{{{base},"parcel":"x-TEST"}}': "filtered",
        '{"parcel":"p","network":"north"}': "filtered", '{"kind":"other","parcel":"p","network":"north"}': "filtered",
        '{"kind":"scanned","parcel":"p","network":"west"}': "filtered",
    }
    df = ingest.parse_records(spark.createDataFrame([(k,) for k in cases], "value string"))
    assert {r["value"]: r["tag"] for r in ingest.tag(df, parcel, "record").collect()} == cases


def test_single_map_takes_one_row_an_event(spark):
    """A schema of one map makes no second row of an event for plain fields that it does not have; entries are gathered without a partial step."""
    schema = Schema("t", 1, "t", "{k}", {"m": SCHEMA.fields["m"]})
    rows = [("a", True, "1", "x", "e"), ("a", True, "2", "y", "e"), ("a", True, "2", None, "f"), ("b", False, "1", "x", "e"), ("c", True, "zz", None, "e"), ("c", True, "1", "x", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, k string, g boolean, c string, p string, e string")
    out = fold.fold(ingest.admitted(df, schema), schema)
    found = {r["session_key"]: r["m"] and {k: tuple(s) for k, s in r["m"].items()} for r in out.collect()}
    assert found == {"a": {"e": (2, "y"), "f": (2, None)}, "b": None, "c": {"e": (0, None)}}
    plan = out._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert "Generate" not in plan and plan.count("partial_collect_list") == 1
    assert plan.index("partial_collect_list") < plan.index("REPARTITION_BY_COL")  # a plan prints what reads first


def test_text_after_a_value_is_malformed(spark):
    """Whatever closes the brackets that a record is parsed in; the text is parsed once."""
    texts = {'{"a":1}': '{"a":1}', '{"a":1}]': None, "1] [2": None, "1,0] [": None, "1],[2": None, "1,2": None, " \t[1]\n": "[1]", "": None, '{"a":{"b":[1,2.5,"z",null]}}': '{"a":{"b":[1,2.5,"z",null]}}'}
    df = ingest.parse_records(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert {r[0]: r[1] for r in df.select("value", F.to_json("record")).collect()} == texts
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
