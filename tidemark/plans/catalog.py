"""The named queries over the shared tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import capture, events, stars


def queries() -> dict:
    return events.QUERIES | stars.QUERIES | capture.QUERIES


def oracle_sql() -> dict[str, str]:
    return events.SQL | stars.SQL | capture.SQL
