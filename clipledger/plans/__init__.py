"""Registered queries: each pairs a Spark plan with the SQL that must give the same rows."""

from clipledger.plans.registry import ORACLES, QUERIES  # noqa: F401
from clipledger.plans import (  # noqa: F401
    aggregates,
    catalog,
    gates,
    graphs,
    joins,
    lineage,
    models,
    selection,
    splits,
    streams,
    surfaces,
    windows,
)
