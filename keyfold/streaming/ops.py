"""Operations: point reads with their status codes, printing for a dry run, settings."""

from __future__ import annotations

import hmac
import json
import logging
import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.sources.state import StateTable

#: Field names whose values are not printed.
REDACTED = ("email", "phone", "token", "password", "ip")


@dataclass
class Settings:
    """Values of a TOML file, then of an override file, then of KEYFOLD__ environment variables."""

    servers: str = "localhost:9092"
    topics: list[str] = field(default_factory=list)
    start: str = "latest"
    batch_count: int = 100_000
    batch_interval: str = "1 second"
    path: str = "keyfold-data"
    api_key: str = ""
    enrichment_file: str = ""
    reload_secs: float = 43_200
    output_servers: str = ""  # Kafka for deltas and dead letters; empty: Parquet below path
    dead_topic: str = "dead-letters"
    compact_every: int = 20
    ttl_secs: float = 0.0  # 0: sessions are kept for good
    http_port: int = 0  # 0: no HTTP front
    json_logs: bool = False
    sample: float = 1.0
    key_contains: str = ""
    redact: list[str] = field(default_factory=lambda: list(REDACTED))

    @classmethod
    def load(cls, *files: str, env: dict[str, str] | None = None) -> "Settings":
        values: dict = {}
        for f in files:
            values |= tomllib.loads(Path(f).read_text())
        for f in fields(cls):
            raw = (os.environ if env is None else env).get(f"KEYFOLD__{f.name.upper()}")
            if raw is not None:
                kind = type(getattr(cls(), f.name))
                values[f.name] = raw.split(",") if kind is list else raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out = cls(**values)
        if out.batch_count <= 0 or not 0 < out.sample <= 1:
            raise ValueError("batch_count must be over 0 and sample over 0 up to 1")
        return out

    def masked(self) -> dict:
        return {f.name: "***" if f.name == "api_key" else getattr(self, f.name) for f in fields(self)}


def state_response(table: StateTable, id_type: str, params: dict[str, str], key: str | None, api_key: str) -> tuple[int, dict]:
    """Status and body of a point read. Closed without a configured key; the key is checked before the parameters."""
    if not api_key or not hmac.compare_digest((key or "").encode(), api_key.encode()):
        return 401, {"error": "unauthorized"}
    if not params.get("id_type") or not params.get("id"):
        return 400, {"error": "id_type and id must not be empty"}
    if params["id_type"] != id_type:
        return 400, {"error": f"this instance serves {id_type}"}
    found = table.get(params["id"])
    if found is None:
        return 404, {"error": "no state"}
    return 200, {"id_type": id_type, "id": params["id"], "version": found["state_version"], "state": json.loads(found["state"])}


def redact(payload: str, names: tuple[str, ...] = REDACTED) -> str:
    """A JSON text with *** for the values of some names at any depth; other text only by its size."""
    try:
        value = json.loads(payload)
    except ValueError:
        return f"<{len(payload.encode())} bytes>"

    def clean(x):
        if isinstance(x, dict):
            return {k: "***" if k.lower() in names else clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(value), ensure_ascii=False)


def shown(deltas: DataFrame, sample: float = 1.0, key_contains: str = "", rows: int = 20, names: tuple[str, ...] = REDACTED) -> list[str]:
    """A few deltas as lines for a terminal."""
    picked = deltas.where(F.contains(F.col("key"), F.lit(key_contains)) & (F.rand() < sample))
    return [f"{r['sign']:+d} {r['topic']} {r['key']} {redact(r['payload'], names)}" for r in picked.limit(rows).collect()]


class JsonLines(logging.Formatter):
    """Log records as JSON objects, one a line; `figures` of a record are fields of their own."""

    def format(self, record: logging.LogRecord) -> str:
        held = {"at": round(record.created, 3), "level": record.levelname, "logger": record.name, "message": record.getMessage(), **getattr(record, "figures", {})}
        if record.exc_info:
            held["error"] = self.formatException(record.exc_info)
        return json.dumps(held, default=str)


def log_to_stderr(as_json: bool) -> None:
    handler = logging.StreamHandler()
    if as_json:
        handler.setFormatter(JsonLines())
    top = logging.getLogger("keyfold")
    top.handlers, top.propagate = [handler], False
    top.setLevel(logging.INFO)
