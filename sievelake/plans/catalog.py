"""The registered queries and their SQL."""

from __future__ import annotations

from sievelake.plans import marks, probes, shapes  # noqa: F401  (marks and probes add to the queries of shapes)

QUERIES: dict = dict(shapes.QUERIES)
ORACLE_SQL: dict = dict(shapes.ORACLE_SQL)
