"""All queries of the library and their SQL, gathered from the query modules."""

from __future__ import annotations

from terrane.plans import environment, files, land, models, networks, relational, rules, space, statistics, streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (relational, statistics, space, environment, networks, models, rules, land, files, streams):
    QUERIES |= _module.registry.queries
    ORACLE_SQL |= _module.registry.sql
