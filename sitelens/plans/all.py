"""All registered queries and their SQL."""

from __future__ import annotations

from ..sources.tables import with_views
from . import catalog_plans, feed_plans, flagship, page_plans, report_plans, scoring_plans, similarity_plans  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

QUERIES = dict(QUERIES)
ORACLE_SQL = {name: with_views(sql) for name, sql in ORACLE_SQL.items()}
