"""All queries of the engine and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from corpusgrid.operators import coding, content, dedup, hierarchy, planning, recovery, selection, telemetry
from corpusgrid.oracles import coding as coding_sql
from corpusgrid.oracles import content as content_sql
from corpusgrid.oracles import layout
from corpusgrid.oracles import streaming as streaming_sql
from corpusgrid.oracles import telemetry as telemetry_sql
from corpusgrid.sources import container
from corpusgrid.streaming import progress

MODULES = [planning, selection, dedup, hierarchy, content, telemetry, coding, recovery, progress, container]
ORACLES = [layout, content_sql, telemetry_sql, coding_sql, streaming_sql]


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in ORACLES for k, v in m.SQL.items()}
