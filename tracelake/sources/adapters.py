"""Adapters of outside session formats, by name: how records become canonical events, and events become lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import normalize


@dataclass(frozen=True)
class Adapter:
    """``events``: records (file, ord, value) to events; ``lines``: events to native lines, where the format can be written."""

    name: str
    events: Callable[[DataFrame], DataFrame]
    lines: Callable[[DataFrame], DataFrame] | None = None


_adapters: dict[str, Adapter] = {}


def register(adapter: Adapter) -> None:
    """Adds or replaces an adapter."""
    _adapters[adapter.name] = adapter


def adapter(name: str) -> Adapter:
    if name not in _adapters:
        raise KeyError(f"no adapter named {name}; known: {', '.join(sorted(_adapters))}")
    return _adapters[name]


def names() -> list[str]:
    return sorted(_adapters)


register(
    Adapter(
        "project",
        lambda records: normalize.canonical_events(normalize.project_messages(records).withColumnRenamed("file", "session_id")),
        normalize.native_lines
    )
)
register(Adapter("rollout", normalize.rollout_events))
