"""The transition matrix, retention, ids, and the worked example."""

import json

from pyspark.sql import functions as F

from keyfold.functions import values as v
from keyfold.operators import fold, ingest, transition
from keyfold.operators.schema import Retention, Stream
from keyfold.plans.parcels import SCHEMA, TRANSFORMER

STATE = "struct<gate:boolean,m:map<string,struct<comparator:bigint,payload:struct<x:string,k:string,t:bigint>>>>"
ROWS = Stream("rows", "out", explode="m", gate=lambda s: s.value("gate"), key=lambda s: s.each("payload.k"), each={"x": lambda s: s.each("payload.x")})


def signs(spark, old, new, stream=ROWS, now=0):
    pack = lambda s: s and (s[0], {"r": (1, s[1])} if s[1] else {})
    df = spark.createDataFrame([("s", pack(old), pack(new))], f"session_key string, old {STATE}, new {STATE}")
    return sorted((r["sign"], r["key"], r["correlation_id"]) for r in transition.render(df, stream, now).collect())


def test_matrix(spark):
    a, b, bad = ("1", "k", 0), ("2", "k", 0), ("1", " ", 0)
    kinds = lambda *x: [(s, k) for s, k, _ in signs(spark, *x)]
    assert kinds((False, a), (False, b)) == []
    assert kinds((False, a), (True, b)) == [(1, "k")]
    assert kinds(None, (True, b)) == [(1, "k")]
    assert kinds((True, a), (False, b)) == [(-1, "k")]
    assert kinds((True, a), (True, a)) == []
    assert kinds((True, a), (True, b)) == [(-1, "k"), (1, "k")]
    assert kinds((True, a), (True, ("1", "k2", 0))) == [(-1, "k"), (1, "k2")]
    assert kinds((True, bad), (True, a)) == [(1, "k")]
    assert kinds((True, a), (True, bad)) == [(-1, "k")]
    assert kinds((True, bad), (True, bad)) == []
    assert kinds((True, None), (True, a)) == [(1, "k")]
    assert kinds((True, a), (True, None)) == []
    pair = signs(spark, (True, a), (True, b))
    assert pair[0][2] == pair[1][2]


def test_retention_boundary(spark):
    def at(unit, t):
        stream = Stream("rows", "out", explode="m", each={"t": lambda s: s.each("payload.t")}, retention=Retention(1, "t", unit))
        return len(signs(spark, None, (True, ("1", "k", t)), stream, now=100_000))

    assert at("seconds", 100_000 - 86_400) == 0  # as old as the retention: out
    assert at("seconds", 100_000 - 86_399) == 1
    assert at("millis", (100_000 - 86_399) * 1000 + 999) == 1
    assert at("seconds", None) == 1


def test_fnv_vectors(spark):
    parts = ["device", "out", "dev_DEMO001-site_DEMO", "in", "0", "5", "", '{"a":1,"sign_flag":1}']
    rows = spark.createDataFrame([([],), (parts,), ([*parts, "+1"],)], "p array<string>")
    assert [r[0] for r in rows.select(transition.fnv128("p")).collect()] == ["6c62272e07bb014262b821756295c58d", "4175dca99e9b8f3c8dbe56342ff73ebd", "15915ae62614f673bff25846611555ff"]


EVENTS = [
    '{"kind":"booked","network":"north","parcel":"P-17","revision":1,"sender":"unknown","service":"slow","due":1900000000}',
    '{"kind":"charged","charge":{"parcel":"P-17","network":"north","invoice":"i1","amount":"12","day":1899900000}}',
    '{"kind":"scanned","scan":{"parcel":"P-17","network":"north","depot":"Kiel","courier":"c4","at":"2030-03-01T08:00:00Z"}}',
    '{"kind":"rebooked","network":"north","parcel":"P-17","revision":2,"sender":"Ada","service":" ","due":1900000000}',
    '{"kind":"scanned","scan":{"parcel":"P-17","network":"north","depot":"Bern","courier":"","at":"2030-03-01T06:30:00+01:00"}}',
    '{"kind":"charged","charge":{"parcel":"P-17","network":"north","invoice":"i2","amount":2.5,"day":1899990000}}',
]


def local(spark, lines, at=0):
    df = spark.createDataFrame([(at + i, x) for i, x in enumerate(lines)], "seq int, value string")
    return fold.fold(ingest.admitted(ingest.parse_records(df), SCHEMA, "record"), SCHEMA, "record")


def test_worked_example(spark):
    first = local(spark, EVENTS)
    nothing = fold.elided(first, SCHEMA).where("false")
    states = fold.merge(nothing, first, SCHEMA)
    new = json.loads(states.select(F.to_json("new")).first()[0])
    assert (new["booking"]["comparator"], new["booking"]["payload"]["revision"], new["sender"], new["courier"], new["scans"]) == (2, 2, "Ada", "c4", 2)
    assert {k: s["comparator"] for k, s in new["depots"].items()} == {"Kiel": 1898582400 * 10**9, "Bern": 1898573400 * 10**9}
    assert {k: s["comparator"] for k, s in new["charges"].items()} == {"i1": 1899900000 * 10**9, "i2": 1899990000 * 10**9}
    out = {(r["stream"], r["key"]): r["payload"] for r in transition.deltas(states, TRANSFORMER, 1900000000).collect()}
    assert out == {
        ("parcels", "P-17"): '{"cost":14.5,"courier":"c4","depots":2,"due":1900000000,"last_depot":"Kiel","scans":2,"sender":"Ada","service":"standard","sign_flag":1}',
        ("charges", "i1/P-17"): '{"amount":"12","day":1899849600,"euros":12,"sender":"Ada","sign_flag":1}',
        ("charges", "i2/P-17"): '{"amount":2.5,"day":1899936000,"euros":2,"sender":"Ada","sign_flag":1}',
    }

    more = local(spark, [EVENTS[1].replace('"12"', "13")], 10)  # an equal comparator: the newer event counts
    again = fold.merge(states.select("session_key", "new.*"), more, SCHEMA)
    rows = transition.deltas(again, TRANSFORMER, 1900000000).collect()
    costs = [(r["stream"], r["sign"], json.loads(r["payload"]).get("cost"), json.loads(r["payload"]).get("amount")) for r in rows]
    assert costs == [("parcels", -1, 14.5, None), ("parcels", 1, 15.5, None), ("charges", -1, None, "12"), ("charges", 1, None, 13)]
    assert rows[0]["correlation_id"] == rows[1]["correlation_id"] != rows[2]["correlation_id"]
    late = transition.deltas(again, TRANSFORMER, 1900000000 + 30 * 86400).collect()
    assert {r["stream"] for r in late} == {"charges"}
    assert transition.check(SCHEMA, TRANSFORMER, again) == []


def test_all_findings_in_one_pass(spark):
    first = local(spark, EVENTS)
    states = fold.merge(fold.elided(first, SCHEMA).where("false"), first, SCHEMA)
    wrong = Stream("w", "t", explode="nothing", each={"a": lambda s: s.each("payload")}, lookups={"x": ("sites", lambda s: s.value("sender"))})
    missing = Stream("m", "t", columns={"a": lambda s: s["nope"], "b": lambda s: s["nay"], "c": lambda s: s.value("sender")}, gate=lambda s: s["no"] > 1)
    found = transition.check(SCHEMA, type(TRANSFORMER)((wrong, missing, *TRANSFORMER.streams)), states)
    assert [x.split(":")[0] for x in found] == ["[stream w] look-up x", "[stream w] explode", "[stream m] columns a", "[stream m] columns b", "[stream m] gate"]


def test_a_projection_of_ones_own(spark):
    """Anything with `deltas` stands beside streams."""

    class Log:
        name, topic, lookups = "log", "log-lines", {}

        def problems(self):
            return []

        def deltas(self, states, now, enrichment=None):
            return transition.render(states, Stream("log", "log-lines", sign_flag=False, columns={"seen": lambda s: s.value("scans")}), now)

    first = local(spark, EVENTS)
    states = fold.merge(fold.elided(first, SCHEMA).where("false"), first, SCHEMA)
    rows = transition.deltas(states, type(TRANSFORMER)((Log(), *TRANSFORMER.streams)), 0).collect()
    assert [r["payload"] for r in rows if r["topic"] == "log-lines"] == ['{"seen":2}']


def test_row_overrides_common_unless_null(spark):
    stream = Stream("c", "t", columns={"a": lambda s: v.lit(None), "b": lambda s: v.lit("row")}, common={"a": lambda s: v.lit("common"), "b": lambda s: v.lit("common")})
    df = spark.createDataFrame([("s", None, (True, {}))], f"session_key string, old {STATE}, new {STATE}")
    assert transition.render(df, stream, 0).first()["payload"] == '{"a":"common","b":"row","sign_flag":1}'


def test_lookup(spark):
    dimension = spark.createDataFrame([("t", "k", '{"n":5}'), ("other", "k", "1")], "table string, key string, value string").withColumn("value", F.try_parse_json("value"))
    stream = Stream("l", "t", explode="m", each={"n": lambda s: v.get(s.lookup("a"), "n"), "miss": lambda s: s.lookup("b")}, lookups={"a": ("t", lambda s: s.each("payload.k")), "b": ("t", lambda s: s.each("payload.x"))})
    df = spark.createDataFrame([("s", None, (True, {"r": (1, ("1", "k", 0))}))], f"session_key string, old {STATE}, new {STATE}")
    assert transition.render(df, stream, 0, enrichment=dimension).first()["payload"] == '{"n":5,"sign_flag":1}'
    assert transition.check(SCHEMA, type(TRANSFORMER)((stream,)), df, dimension) != []  # m is no field of that schema


def test_gate_reads_lookups(spark):
    dimension = spark.createDataFrame([("on", "k", "yes"), ("on", "z", "")], "table string, key string, value string")
    stream = Stream("g", "t", explode="m", each={"x": lambda s: s.each("payload.x"), "of": lambda s: s.lookup("entry")}, gate=lambda s: s.lookup("state"),
                    lookups={"state": ("on", lambda s: v.lit("k")), "entry": ("on", lambda s: s.each("payload.k"))})
    df = spark.createDataFrame([("s", None, (True, {"r": (1, ("1", "k", 0))}))], f"session_key string, old {STATE}, new {STATE}")
    assert [r["payload"] for r in transition.render(df, stream, 0, enrichment=dimension).collect()] == ['{"of":"yes","sign_flag":1,"x":"1"}']
    shut = Stream(**{**stream.__dict__, "lookups": {**stream.lookups, "state": ("on", lambda s: v.lit("z"))}})
    assert transition.render(df, shut, 0, enrichment=dimension).count() == 0


def test_fnv_of_many_rows():
    def one(raw):
        h = 0x6C62272E07BB014262B821756295C58D
        for b in raw:
            h = ((h ^ b) * 0x0000000001000000000000000000013B) % 2**128
        return f"{h:032x}"

    texts = [b"", b"a", bytes(range(256)), b"\xff" * 40, b"a"]
    assert transition.fnv128_rows(texts) == [one(t) for t in texts] and transition.fnv128_rows([]) == []
