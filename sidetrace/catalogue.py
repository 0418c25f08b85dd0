"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from sidetrace.plans import audit, joins, schedules, spatial
from sidetrace.plans.base import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (schedules, joins, spatial, audit):
    QUERIES |= _module.R.queries
    ORACLE_SQL |= _module.R.sql
