"""All catalog entries."""

from __future__ import annotations

from herdwatch.catalog import access, lifecycle, registry, settings, snapshots, streams, telemetry
from herdwatch.catalog.base import Entry

AREAS = (telemetry, lifecycle, snapshots, registry, access, settings, streams)


def entries() -> list[Entry]:
    found = [e for area in AREAS for e in area.entries()]
    names = [e.name for e in found]
    if len(set(names)) != len(names):
        raise ValueError("catalog names must be unique")
    return found
