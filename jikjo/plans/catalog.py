"""All queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from jikjo.plans import builds, corpus, evaluation, mining, telemetry, variants  # noqa: F401
from jikjo.plans.registry import QUERIES, SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
FLAGSHIP = "g1_quality_by_source"
