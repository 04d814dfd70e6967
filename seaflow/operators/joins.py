"""Join analyses over the freight model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import exact_sum, ratio, totals
from seaflow.operators.network import port_role
from seaflow.sources.tables import FreightTables


def in_transit_shipments(t: FreightTables) -> DataFrame:
    """Shipments under way with customer and vessel."""
    return (
        t.shipment.filter("status = 'In Transit'")
        .select("bl_number", "customer_id", "voyage_id", "incoterms", "total_value_usd")
        .join(
            t.customer.selectExpr("customer_id", "company_name", "country_code as customer_country"), "customer_id"
        )
        .join(t.voyage.select("voyage_id", "vessel_id"), "voyage_id")
        .join(t.vessel.select("vessel_id", "vessel_name", "vessel_type"), "vessel_id")
        .select(
            "bl_number",
            "company_name",
            "customer_country",
            "vessel_name",
            "vessel_type",
            "incoterms",
            "total_value_usd",
        )
        .orderBy(F.desc("total_value_usd"), "bl_number")
    )


def leg_totals(t: FreightTables) -> DataFrame:
    """Legs and miles of each route that has legs."""
    return totals(t.route_leg, ["route_id"], "count(*) as legs", "sum(distance_nm) as total_distance_nm")


def route_leg_audit(t: FreightTables) -> DataFrame:
    """Legs and miles per route; a route without legs keeps a NULL distance."""
    return (
        t.route.join(leg_totals(t), "route_id", "left")
        .selectExpr(
            "route_id",
            "route_name",
            "service_name",
            "transit_days",
            "coalesce(legs, 0) as leg_count",
            "total_distance_nm",
        )
        .orderBy("route_id")
    )


def shipment_manifest(t: FreightTables) -> DataFrame:
    """Every shipment with customer, vessel and both ports, newest booking first."""
    return (
        t.shipment.join(t.customer.select("customer_id", "company_name"), "customer_id")
        .join(t.voyage.selectExpr("voyage_id", "vessel_id", "status as voyage_status"), "voyage_id")
        .join(t.vessel.select("vessel_id", "vessel_name"), "vessel_id")
        .join(port_role(t, "origin", "un_locode", "port_name"), "origin_port_id")
        .join(port_role(t, "dest", "un_locode", "port_name"), "dest_port_id")
        .orderBy(F.desc("booking_date"), "bl_number")
        .selectExpr(
            "bl_number",
            "company_name",
            "vessel_name",
            "origin_un_locode as origin_locode",
            "origin_port_name as origin_port",
            "dest_un_locode as dest_locode",
            "dest_port_name as dest_port",
            "incoterms",
            "total_weight_kg",
            "total_value_usd",
            "voyage_status",
        )
    )


def consecutive_legs(t: FreightTables) -> DataFrame:
    """Each leg paired with the one that follows it on the same route."""
    first = t.route_leg.selectExpr(
        "route_id",
        "leg_sequence as leg_num",
        "from_port_id",
        "to_port_id as mid_port_id",
        "distance_nm as leg1_nm",
    )
    second = t.route_leg.selectExpr(
        "route_id", "leg_sequence - 1 as leg_num", "to_port_id", "distance_nm as leg2_nm"
    )
    return (
        first.join(second, ["route_id", "leg_num"])
        .join(t.route.select("route_id", "route_name"), "route_id")
        .join(port_role(t, "from", "port_name"), "from_port_id")
        .join(port_role(t, "mid", "port_name"), "mid_port_id")
        .join(port_role(t, "to", "port_name"), "to_port_id")
        .selectExpr(
            "route_name",
            "leg_num",
            "from_port_name as departure_port",
            "mid_port_name as junction_port",
            "to_port_name as arrival_port",
            "leg1_nm",
            "leg2_nm",
            "leg1_nm + leg2_nm as combined_nm",
        )
        .orderBy("route_name", "leg_num")
    )


def above_route_average(t: FreightTables) -> DataFrame:
    """Shipments worth more than the average shipment on their route.

    The averages are one row per route, so the comparison is a join and not a window over whole routes. They come
    from sums per voyage, which keeps single shipments out of that branch's shuffle.
    """
    voyages = t.voyage.select("voyage_id", "route_id")
    per_voyage = totals(
        t.shipment,
        ["voyage_id"],
        f"{exact_sum('total_value_usd')} as usd",
        "count(total_value_usd) as n",
    )
    means = totals(
        per_voyage.join(voyages, "voyage_id"),
        ["route_id"],
        f"{ratio('sum(usd)', 'sum(n)')} as mean_value",
    )
    return (
        t.shipment.select("bl_number", "customer_id", "voyage_id", "total_value_usd", "status")
        .join(voyages.join(means, "route_id"), "voyage_id")
        .filter("total_value_usd > mean_value")
        .join(t.customer.select("customer_id", "company_name"), "customer_id")
        .join(t.route.select("route_id", "route_name"), "route_id")
        .select("bl_number", "company_name", "route_name", "total_value_usd", "status")
        .orderBy(F.desc("total_value_usd"), "bl_number")
    )


def voyages_with_customs_hold(t: FreightTables) -> DataFrame:
    """Voyages, with vessel, that carry at least one shipment held by customs."""
    held = t.shipment_event.filter("event_type = 'Customs Hold'").select("shipment_id").distinct()
    voyages = t.shipment.join(held, "shipment_id", "left_semi").select("voyage_id").distinct()
    return (
        t.voyage.join(voyages, "voyage_id", "left_semi")
        .join(t.vessel.select("vessel_id", "vessel_name", "imo_number", "operator"), "vessel_id")
        .selectExpr("vessel_name", "imo_number", "operator", "voyage_number", "status as voyage_status")
        .distinct()
        .orderBy("vessel_name", "voyage_number")
    )
