"""Columns that are made once: a stream's batches share them, since making one costs calls to the JVM."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")


def once(made: dict | None, key: Hashable, build: Callable[[], T]) -> T:
    """What `build` gives, kept in `made` (if there is one) under a key."""
    if made is None:
        return build()
    if key not in made:
        made[key] = build()
    return made[key]
