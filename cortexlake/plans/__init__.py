"""Named queries, by the operator they show."""

from cortexlake.plans import arrays, fields, groups, measures, naming, spectra, tables, timelines  # noqa: F401
from cortexlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
