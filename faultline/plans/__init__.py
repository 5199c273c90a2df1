"""Registered queries over the driver's tables, each with its DuckDB twin."""

from faultline.plans import registry
from faultline.plans import (  # noqa: F401  (imports fill the registry)
    archives,
    audits,
    evaluations,
    graph,
    incidents,
    normalization,
    statistics,
    streams,
    surfaces,
)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
