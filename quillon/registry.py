"""The named queries of the engine's own operators and their SQL."""

from __future__ import annotations

from quillon.plans import stores, tables, text, timeline  # noqa: F401  (they register their queries)
from quillon.plans.base import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
