"""Fleet KPIs: use of the vessels and of their container capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import ACTIVE_VOYAGE, percent, tally, teu, totals
from seaflow.sources.tables import FreightTables


def vessel_utilization(t: FreightTables) -> DataFrame:
    """Voyages per vessel, in total and by state; vessels without voyages count zero."""
    voyages = totals(
        t.voyage,
        ["vessel_id"],
        "count(*) as total_voyages",
        tally("status = 'Completed'") + " as completed",
        tally(ACTIVE_VOYAGE) + " as active",
        tally("status = 'Scheduled'") + " as scheduled",
        tally("status = 'Arrived'") + " as arrived",
    )
    counts = ("total_voyages", "completed", "active", "scheduled", "arrived")
    return (
        t.vessel.join(voyages, "vessel_id", "left")
        .selectExpr(
            "vessel_name", "operator", "teu_capacity", "year_built", *[f"coalesce({c}, 0) as {c}" for c in counts]
        )
        .orderBy(F.desc("total_voyages"), "vessel_name")
    )


def capacity_vs_booked_teu(t: FreightTables) -> DataFrame:
    """Containers and booked TEU per voyage against the capacity of its vessel.

    A shipment without containers, and a voyage without shipments, counts as one TEU: the outer joins leave one
    empty row each, and an unknown container type is worth 1. Containers are folded to one row per shipment and
    shipments to one row per voyage before they are joined.
    """
    per_shipment = totals(t.container, ["shipment_id"], "count(*) as n", f"sum({teu('container_type')}) as teu")
    per_voyage = totals(
        t.shipment.select("shipment_id", "voyage_id").join(per_shipment, "shipment_id", "left"),
        ["voyage_id"],
        "sum(coalesce(n, 0)) as n",
        "sum(coalesce(teu, 1)) as teu",
    )
    return (
        t.voyage.select("voyage_id", "vessel_id", "voyage_number", "status")
        .join(per_voyage, "voyage_id", "left")
        .join(t.vessel.select("vessel_id", "vessel_name", "operator", "teu_capacity"), "vessel_id")
        .selectExpr(
            "vessel_name",
            "operator",
            "teu_capacity",
            "voyage_number",
            "status",
            "coalesce(n, 0) as container_count",
            "coalesce(teu, 1) as booked_teu",
            f"{percent('coalesce(teu, 1)', 'teu_capacity')} as utilization_pct",
        )
        .orderBy(F.desc_nulls_last("utilization_pct"), "voyage_number")
    )


KPIS = {"vessel_utilization": vessel_utilization, "capacity_vs_booked_teu": capacity_vs_booked_teu}
