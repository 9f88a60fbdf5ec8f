"""All queries of the engine and their SQL."""

from __future__ import annotations

from lorespark import queries, queries_more, sql

QUERIES = queries.QUERIES | queries_more.QUERIES
SQL = sql.SQL | queries_more.SQL
