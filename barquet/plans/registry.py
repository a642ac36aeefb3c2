"""All queries of the market-analytics operators, and the SQL that gives the same rows."""

from __future__ import annotations

from . import context, market, profiles, reports, study

QUERIES: dict = {**market.QUERIES, **study.QUERIES, **reports.QUERIES, **context.QUERIES, **profiles.QUERIES}
ORACLE_SQL: dict[str, str] = {**market.ORACLE_SQL, **study.ORACLE_SQL, **reports.ORACLE_SQL, **context.ORACLE_SQL, **profiles.ORACLE_SQL}
