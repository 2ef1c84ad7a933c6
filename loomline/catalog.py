"""Every query of the library by name, and the SQL it is held against."""

from __future__ import annotations

from .plans import aggregation, artifacts, changes, dataflow, filtering, joining, named, ordering, parsing, projecting, reconciling, records, rules, windowing  # noqa: F401
from .registry import ORACLES, QUERIES
from .streaming import events, steps  # noqa: F401

FLAGSHIP = "results_page"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
