"""All registered queries of the measures."""

from plumbline.plans import inputs, reports, sources  # noqa: F401  (they register their queries)
from plumbline.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
