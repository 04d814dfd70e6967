"""Container-shipping analytics on Spark DataFrames."""

from seaflow.operators.catalog import commercial, fleet, get_all_kpis, network, operations
from seaflow.operators.querylog import audit, guarded_query
from seaflow.sources.tables import FreightTables

__all__ = [
    "FreightTables",
    "audit",
    "commercial",
    "fleet",
    "get_all_kpis",
    "guarded_query",
    "network",
    "operations",
]
