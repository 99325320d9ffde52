"""All registered queries and their SQL twins."""

from __future__ import annotations

from pointmill.plans import catalog_queries, curation_queries, feed_queries, point_queries  # noqa: F401
from pointmill.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
