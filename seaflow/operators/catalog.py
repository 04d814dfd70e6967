"""The KPIs by category, and all of them at once; every result is a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seaflow.operators import commercial as commercial_kpis
from seaflow.operators import fleet as fleet_kpis
from seaflow.operators import network as network_kpis
from seaflow.operators import operations as operations_kpis
from seaflow.sources.tables import FreightTables

CATEGORIES = {
    "fleet": fleet_kpis.KPIS,
    "network": network_kpis.KPIS,
    "operations": operations_kpis.KPIS,
    "commercial": commercial_kpis.KPIS,
}


def category(t: FreightTables, name: str) -> dict[str, DataFrame]:
    return {kpi: build(t) for kpi, build in CATEGORIES[name].items()}


def fleet(t: FreightTables) -> dict[str, DataFrame]:
    return category(t, "fleet")


def network(t: FreightTables) -> dict[str, DataFrame]:
    return category(t, "network")


def operations(t: FreightTables) -> dict[str, DataFrame]:
    return category(t, "operations")


def commercial(t: FreightTables) -> dict[str, DataFrame]:
    return category(t, "commercial")


def get_all_kpis(t: FreightTables) -> dict[str, DataFrame]:
    return {kpi: df for name in CATEGORIES for kpi, df in category(t, name).items()}
