"""Registered queries (one per SURVEY §2 operator) and their DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs an operator over the
whole driver tables; ``ORACLE[name]`` is the same computation as SQL for
DuckDB.  Computed doubles are rounded to 4 places in both engines so that
summation order cannot change the value hash.
"""

from __future__ import annotations

from turnstile.plans.registry import ORACLE, QUERIES, register, round_doubles  # noqa: F401

# Importing the per-group modules runs their @register decorators.
from turnstile.plans import q_metrics  # noqa: E402,F401
from turnstile.plans import q_features  # noqa: E402,F401
from turnstile.plans import q_monitoring  # noqa: E402,F401
from turnstile.plans import q_requests  # noqa: E402,F401
from turnstile.plans import q_models  # noqa: E402,F401
from turnstile.plans import q_streaming  # noqa: E402,F401
from turnstile.plans import q_workflows  # noqa: E402,F401

__all__ = ["QUERIES", "ORACLE"]
