"""python -m keyfold run|check|state MODULE ...: MODULE has SCHEMA and TRANSFORMER."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import threading

from pyspark.sql import SparkSession

from keyfold.operators import fold, transition
from keyfold.sources import events
from keyfold.sources.enrichment import Enrichment
from keyfold.streaming.ops import Settings, log_to_stderr, shown, state_response
from keyfold.streaming.runner import Runner
from keyfold.streaming.server import serve


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="keyfold", description=__doc__)
    parser.add_argument("command", choices=["run", "check", "state"])
    parser.add_argument("module", help="Python module with SCHEMA and TRANSFORMER, such as keyfold.plans.parcels")
    parser.add_argument("--config", action="append", default=[], help="TOML files, later ones first in rank")
    parser.add_argument("--files", help="a folder of JSON lines instead of Kafka")
    parser.add_argument("--inspect", action="store_true", help="dry run: print deltas, write nothing")
    parser.add_argument("--id", default="", help="session key for the state command")
    opts = parser.parse_args(args)
    settings, declared = Settings.load(*opts.config), importlib.import_module(opts.module)
    log_to_stderr(settings.json_logs)
    spark = SparkSession.builder.appName("keyfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    runner = build(spark, settings, declared, opts.inspect)
    if opts.command == "check":
        local = spark.createDataFrame([], runner.state.schema)
        states, held = fold.merge(local, local, declared.SCHEMA), runner.enrichment
        found = transition.check(declared.SCHEMA, declared.TRANSFORMER, states, held and held.rows())
        print(*(found or ["no findings"]), sep="\n")
        return int(bool(found))
    if opts.command == "state":
        status, body = state_response(runner.state, declared.SCHEMA.id_type, {"id_type": declared.SCHEMA.id_type, "id": opts.id}, settings.api_key, settings.api_key)
        print(status, json.dumps(body))
        return int(status != 200)
    if settings.http_port:
        threading.Thread(target=serve(runner, settings.api_key, "0.0.0.0", settings.http_port).serve_forever, daemon=True).start()
    if opts.files:
        source = events.json_files(spark, opts.files, "files")
    else:
        source = events.kafka(spark, settings.servers, settings.topics, settings.start, settings.batch_count)
    return runner.run(source, None if opts.files or opts.inspect else settings.batch_interval)


def build(spark: SparkSession, settings: Settings, declared, inspect: bool = False) -> Runner:
    """The runner that some settings and a module with SCHEMA and TRANSFORMER (and, if wanted, UPCASTS) ask for."""
    emit = None
    if inspect:
        emit = lambda d, _: print(*shown(d, settings.sample, settings.key_contains, names=tuple(settings.redact)), sep="\n")
    enrichment = Enrichment(spark, settings.enrichment_file, settings.reload_secs) if settings.enrichment_file else None
    sink = events.KafkaSink(settings.output_servers, settings.dead_topic) if settings.output_servers else events.FileSink(settings.path, settings.dead_topic)
    runner = Runner(
        spark, declared.SCHEMA, declared.TRANSFORMER, settings.path, dry_run=inspect, emit=emit, enrichment=enrichment, sink=sink, compact_every=settings.compact_every
    )
    runner.state.ttl_secs, runner.state.upcasts = settings.ttl_secs or None, getattr(declared, "UPCASTS", {})
    return runner


if __name__ == "__main__":
    sys.exit(main())
