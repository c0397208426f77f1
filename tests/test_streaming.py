import json
import logging
import os
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyfold import __main__ as cli
from keyfold.plans.parcels import SCHEMA, TRANSFORMER
from keyfold.sources import enrichment, events
from keyfold.sources.state import StateTable
from keyfold.streaming import ops, server
from keyfold.streaming.runner import Runner
from tests.test_transition import EVENTS

NOW = 1900000000


def lines_in(path):
    """Three files of two events each; the second one has a malformed line too."""
    os.makedirs(path)
    for i in range(3):
        (path / f"{i}.json").write_text("\n".join(EVENTS[2 * i : 2 * i + 2] + ["{bad"] * (i == 1)) + "\n")
        os.utime(path / f"{i}.json", (1000 + i, 1000 + i))
    return str(path)


def raw(spark, lines, offsets=None, topic="t", partition=0):
    rows = [(None, x.encode(), topic, partition, o, None) for o, x in zip(offsets or range(len(lines)), lines)]
    return spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp")


def test_run_replay_and_reads(spark, tmp_path):
    source = lines_in(tmp_path / "in")
    runner = Runner(spark, SCHEMA, TRANSFORMER, str(tmp_path / "out"), clock=lambda: NOW, compact_every=2, buckets=4)
    assert runner.run(events.json_files(spark, source, "t")) == 0
    assert [m["malformed"] for m in runner.metrics] == [0, 1, 0] and sum(m["admitted"] for m in runner.metrics) == 6
    assert sum(m["deltas to charge-rows"] for m in runner.metrics) == 4 and all(m["sessions_on_several_partitions"] == 0 for m in runner.metrics)
    found = spark.read.parquet(f"{tmp_path}/out/deltas")
    assert {(r["stream"], r["n"]) for r in found.groupBy("stream").agg(F.sum("sign").alias("n")).collect()} == {("parcels", 1), ("charges", 2)}
    assert spark.read.parquet(f"{tmp_path}/out/dead_letters").select(F.col("value").cast("string")).first()[0] == "{bad"

    ask = lambda params, key="k": ops.state_response(runner.state, "parcel", params, key, "k")
    who = {"id_type": "parcel", "id": "P-17"}
    status, body = ask(who)
    assert (status, body["version"], body["state"]["scans"]) == (200, 1, 2)
    assert [ask(who, "x")[0], ask({}, "x")[0], ask({})[0], ask(who | {"id_type": "o"})[0], ask(who | {"id": "zz"})[0]] == [401, 401, 400, 400, 404]
    assert ops.state_response(runner.state, "parcel", who, "", "")[0] == 401

    # a replayed batch replaces its own part: the counter does not count twice, after a snapshot too
    last = spark.read.text(f"{source}/2.json").select("value").collect()
    runner.process(raw(spark, [r[0] for r in last]), 2)
    assert ask(who)[1]["state"]["scans"] == 2
    runner.state.compact(2)
    runner.process(raw(spark, [r[0] for r in last]), 2)
    assert ask(who)[1]["state"]["scans"] == 2

    front = server.serve(runner, "k")
    threading.Thread(target=front.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{front.server_address[1]}"

    def fetch(path, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, headers=headers), timeout=60) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert fetch("/health") == (200, "ok") and fetch("/nothing")[0] == 404
    assert "keyfold_admitted_total 10" in fetch("/metrics")[1] and 'keyfold_deltas_total{topic="charge-rows"}' in fetch("/metrics")[1]
    assert fetch("/state?id_type=parcel&id=P-17")[0] == 401
    assert json.loads(fetch("/state?id_type=parcel&id=P-17", **{"X-Api-Key": "k"})[1])["state"]["scans"] == 2
    front.shutdown()


def test_a_dry_run_leaves_no_trace(spark, tmp_path):
    source, seen = lines_in(tmp_path / "in"), []
    dry = Runner(spark, SCHEMA, TRANSFORMER, str(tmp_path / "out"), clock=lambda: NOW, dry_run=True, emit=lambda d, n: seen.append(d.count()))
    assert dry.run(events.json_files(spark, source, "t")) == 0
    assert len(seen) == 3 and sum(seen) > 0
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []
    real = Runner(spark, SCHEMA, TRANSFORMER, str(tmp_path / "out"), clock=lambda: NOW, buckets=4)
    real.run(events.json_files(spark, source, "t"))
    assert len(real.metrics) == 3 and json.loads(real.state.get("P-17")["state"])["scans"] == 2


def test_arrival_is_by_offset(spark, tmp_path):
    """Offsets order the events of a partition, whatever the producers' clocks say."""
    runner = Runner(spark, SCHEMA, TRANSFORMER, str(tmp_path), clock=lambda: NOW)
    first = '{"kind":"booked","network":"north","parcel":"P-1","revision":1,"sender":"one"}'
    rows = raw(spark, [first.replace('"one"', '"two"'), first], [8, 7]).withColumn("timestamp", F.timestamp_seconds(F.lit(100) + F.col("offset") * F.lit(-1)))
    runner.process(rows, 0)
    state = json.loads(runner.state.get("P-1")["state"])
    assert state["sender"] == "one" and state["booking"]["payload"]["sender"] == "two"
    assert runner.metrics[0]["lag"] == {"t:0": NOW - 93.0}
    runner.process(raw(spark, [first], topic="t").union(raw(spark, [first], topic="u")), 1)
    assert runner.metrics[1]["sessions_on_several_partitions"] == 1


COLUMNS = StructType().add("session_key", "string").add("n", "long")


def test_only_needed_buckets_are_read(spark, tmp_path):
    table = StateTable(spark, str(tmp_path), COLUMNS, clock=lambda: 5.0)
    rows = spark.range(200).select(F.col("id").cast("string").alias("session_key"), "id").toDF("session_key", "n")
    table.write(rows, 0)
    keys = rows.where("n = 7").select("session_key")
    bucket = keys.select(table.bucket_of(F.col("session_key"))).first()[0]
    asked = table.before(1, keys)
    assert [tuple(r) for r in asked.collect()] == [("7", 7)]
    assert len(spark.read.parquet(f"{tmp_path}/parts/batch=0").inputFiles()) > 20
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    scan = [line for line in plan.split("\n") if "FileScan" in line][0]
    assert "(bucket#" in scan and str(bucket) in scan and "BroadcastHashJoin" in plan
    with pytest.raises(ValueError, match="buckets"):
        StateTable(spark, str(tmp_path), COLUMNS, buckets=8).current()


def test_snapshots_ttl_and_upcasts(spark, tmp_path):
    now = [100.0]
    table = StateTable(spark, str(tmp_path), COLUMNS, 2, clock=lambda: now[0])
    old = StateTable(spark, str(tmp_path), StructType().add("session_key", "string").add("n_old", "string"), 1, clock=lambda: now[0])
    put = lambda t, rows, batch: t.write(spark.createDataFrame(rows, t.schema), batch)
    put(old, [("a", "1"), ("b", "2")], 0)
    put(table, [("b", 20), ("c", 30)], 1)
    assert {tuple(r) for r in table.current().collect()} == {("b", 20), ("c", 30)}  # rows of another version are left out
    table.upcasts = {1: (old.schema, lambda d: d.withColumn("n", F.col("n_old").cast("bigint")))}
    held = lambda at=9: {tuple(r) for r in table.before(at).collect()}
    assert held() == {("a", 1), ("b", 20), ("c", 30)} and held(1) == {("a", 1), ("b", 2)}
    now[0] = 200.0
    table.upcasts = {}
    for batch in range(2, 8):
        put(table, [("c", batch), (f"k{batch}", 0)], batch)
        if batch % 2:
            table.compact(batch)
    assert {tuple(r) for r in table.current().collect()} == {("b", 20), ("c", 7), *((f"k{b}", 0) for b in range(2, 8))}
    assert table._numbers("full", "upto") == [5, 7] and table._numbers("parts", "batch") == [6, 7]
    assert {tuple(r) for r in table.before(7).collect()} >= {("c", 6), ("k6", 0)} and not {r[0] for r in table.before(7).collect()} & {"k7"}
    table.ttl_secs, now[0] = 150, 260.0
    assert "b" not in {r[0] for r in table.current().collect()} and table.get("b") is None and json.loads(table.get("c")["state"]) == {"n": 7}


def test_restarts_and_stop(spark, tmp_path):
    """A failed query starts again from its checkpoint, after longer and longer waits; a stop lets the batch that runs end."""
    source, waits, calls = lines_in(tmp_path / "in"), [], []

    def run(name, batch, **more):
        runner = Runner(spark, SCHEMA, TRANSFORMER, str(tmp_path / name), clock=lambda: NOW)
        runner._process = lambda rows, n: batch(runner, n)
        calls.clear()
        waits.clear()
        return runner.run(events.json_files(spark, source, "t"), wait=waits.append, **more)

    def away_twice(runner, n):
        calls.append(n)
        if len(calls) in (2, 3):
            raise OSError("the broker is away")
        runner.metrics.append({})

    assert run("a", away_twice) == 0
    assert (waits, calls) == ([2, 4], [0, 1, 1, 1, 2])
    assert run("b", lambda runner, n: (calls.append(n), runner.stop()), interval="0 seconds") == 0
    assert (waits, calls) == ([], [0])
    with pytest.raises(Exception, match="division"):
        run("c", lambda runner, n: 1 / 0)
    assert waits == [2, 4, 8, 16, 32, 64]


def test_kafka_rows(spark, tmp_path):
    """Rows for the Kafka writer: seven headers of a delta, five of a dead letter."""

    class Kept(events.KafkaSink):
        def _send(self, rows):
            sent.extend(r.asDict(recursive=True) for r in rows.collect())

    sent: list[dict] = []
    runner = Runner(spark, SCHEMA, TRANSFORMER, str(tmp_path), clock=lambda: NOW, sink=Kept("broker:9092", "bad-events"))
    runner.process(raw(spark, [*EVENTS, "{bad"]), 0)
    by = lambda topic: [r for r in sent if r["topic"] == topic]
    assert (len(by("parcel-rows")), len(by("charge-rows")), len(by("bad-events"))) == (1, 2, 1)
    heads = {h["key"]: h["value"].decode() for h in by("parcel-rows")[0]["headers"]}
    assert list(heads) == list(events.HEADERS) and len(heads) == 7
    assert (heads["causation_topic"], heads["causation_partition"], heads["causation_offset"], heads["state_version"], heads["produced_at"]) == ("t", "0", "5", "1", str(NOW))
    bad = by("bad-events")[0]
    assert (bad["key"], bad["value"]) == (b"t:0:6", b"{bad")
    assert [h["key"] for h in bad["headers"]] == ["error", "source_topic", "partition", "offset", "ts"]
    # a change gives -1, then +1
    sent.clear()
    runner.process(raw(spark, [EVENTS[2]], [7]), 1)
    assert [json.loads(r["value"])["sign_flag"] for r in by("parcel-rows")] == [-1, 1]


def test_command_line(spark, tmp_path, capsys):
    source = lines_in(tmp_path / "in")
    (tmp_path / "c.toml").write_text(f'path = "{tmp_path}/out"\napi_key = "s"\njson_logs = true\nkey_contains = "P-"\n')
    args = ["keyfold.plans.parcels", "--config", f"{tmp_path}/c.toml"]
    assert cli.main(["check", *args]) == 0 and "no findings" in capsys.readouterr().out
    assert cli.main(["run", *args, "--files", source, "--inspect"]) == 0
    out = capsys.readouterr()
    assert "+1 parcel-rows P-17" in out.out and not (tmp_path / "out" / "state").exists()
    figures = [json.loads(x) for x in out.err.splitlines() if x.startswith("{")]
    assert [f["batch"] for f in figures if f["message"] == "batch"] == [0, 1, 2]
    assert cli.main(["state", *args, "--id", "P-17"]) == 1
    logging.getLogger("keyfold").handlers.clear()


def test_enrichment_reload(spark, tmp_path):
    path, now = tmp_path / "e.json", [0.0]
    path.write_text('{"sites":{"a":"north","b":{"x":1}}}')
    held = enrichment.Enrichment(spark, str(path), 10, clock=lambda: now[0])
    assert held.rows().count() == 2 and held.tables() == {"sites"}
    now[0] = 11
    path.write_text('{"other":{}}')  # a table is gone: the old content stays
    assert held.tables() == {"sites"}
    path.write_text("[1]")
    with pytest.raises(ValueError):
        enrichment.read(spark, str(path))


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text('servers = "a"\nbatch_count = 5\n')
    (tmp_path / "b.toml").write_text('servers = "b"\napi_key = "s"\n')
    s = ops.Settings.load(str(tmp_path / "a.toml"), str(tmp_path / "b.toml"), env={"KEYFOLD__TOPICS": "x,y"})
    assert (s.servers, s.batch_count, s.topics, s.masked()["api_key"]) == ("b", 5, ["x", "y"], "***")
    (tmp_path / "c.toml").write_text("nope = 1\n")
    with pytest.raises(ValueError):
        ops.Settings.load(str(tmp_path / "c.toml"), env={})


def test_redact():
    assert json.loads(ops.redact('{"a":[{"Email":"x","b":1}]}')) == {"a": [{"Email": "***", "b": 1}]}
    assert ops.redact("{bad") == "<4 bytes>"
