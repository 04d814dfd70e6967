"""Network KPIs: ports, routes and legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import (
    ARRIVED,
    ON_TIME,
    OVER_A_DAY,
    exact_mean,
    exact_sum,
    half_up,
    percent,
    ratio,
    tally,
    totals,
)
from seaflow.sources.tables import FreightTables


def port_calls(t: FreightTables) -> DataFrame:
    """Calls, distinct voyages and mean delay per port that was called at."""
    return totals(
        t.voyage_stop,
        ["port_id"],
        "count(*) as calls",
        "count(distinct voyage_id) as voyages",
        f"{exact_mean('delay_hours')} as mean_delay",
    )


def busiest_ports(t: FreightTables) -> DataFrame:
    """Vessel calls and shipments out and in per port; shipments are reduced to port pairs before counting."""
    pairs = totals(t.shipment, ["origin_port_id", "dest_port_id"], "count(*) as n")
    ends = pairs.selectExpr("stack(2, origin_port_id, n, 0L, dest_port_id, 0L, n) as (port_id, departing, arriving)")
    shipments = totals(ends, ["port_id"], "sum(departing) as departing", "sum(arriving) as arriving")
    return (
        t.port.join(port_calls(t), "port_id", "left")
        .join(shipments, "port_id", "left")
        .selectExpr(
            "port_name",
            "un_locode",
            "country_code",
            "is_transshipment",
            "coalesce(calls, 0) as total_calls",
            "coalesce(voyages, 0) as distinct_voyages",
            "coalesce(departing, 0) as outbound_shipments",
            "coalesce(arriving, 0) as inbound_shipments",
            f"{half_up('mean_delay', 2)} as avg_delay_h",
        )
        .orderBy(F.desc("total_calls"), "un_locode")
    )


def avg_delay_by_route(t: FreightTables) -> DataFrame:
    """Delay profile per route; stops are folded to one row per voyage before they meet the voyages."""
    per_voyage = totals(
        t.voyage_stop,
        ["voyage_id"],
        "count(*) as stops",
        f"{exact_sum('delay_hours')} as delay",
        "max(delay_hours) as worst",
        f"{tally(OVER_A_DAY)} as over_a_day",
        f"{tally(ARRIVED)} as reached",
        f"{tally(ON_TIME)} as punctual",
    )
    per_route = totals(
        t.voyage.select("voyage_id", "route_id").join(per_voyage, "voyage_id"),
        ["route_id"],
        "count(*) as voyage_count",
        "sum(stops) as total_stops",
        f"{half_up(ratio('sum(delay)', 'sum(stops)'), 2)} as avg_delay_h",
        f"{half_up('max(worst)', 2)} as max_delay_h",
        "sum(over_a_day) as stops_over_24h",
        f"{percent('sum(punctual)', 'sum(reached)')} as otp_pct",
    )
    return (
        t.route.join(per_route, "route_id")
        .selectExpr(
            "route_name",
            "service_name",
            "transit_days as scheduled_transit_days",
            "voyage_count",
            "total_stops",
            "avg_delay_h",
            "max_delay_h",
            "stops_over_24h",
            "otp_pct",
        )
        .orderBy(F.desc("avg_delay_h"), "route_name")
    )


def port_role(t: FreightTables, role: str, *columns: str) -> DataFrame:
    """The port table in one role: ``<role>_<column>``, with the key as ``<role>_port_id``."""
    return t.port.selectExpr(*[f"{c} as {role}_{c}" for c in ("port_id", *columns)])


def legs_with_ports(t: FreightTables, *columns: str) -> DataFrame:
    """Route legs with route and the two ports, columns prefixed ``from_`` and ``to_``."""
    return (
        t.route_leg.join(t.route.select("route_id", "route_name", "service_name"), "route_id")
        .join(port_role(t, "from", *columns), "from_port_id")
        .join(port_role(t, "to", *columns), "to_port_id")
    )


def leg_distances(t: FreightTables) -> DataFrame:
    """Every leg with both ports and the implied distance per day."""
    return (
        legs_with_ports(t, "port_name", "un_locode", "country_code")
        .orderBy("route_id", "leg_sequence")
        .selectExpr(
            "route_name",
            "service_name",
            "leg_sequence",
            "from_port_name as from_port",
            "from_un_locode as from_locode",
            "from_country_code as from_country",
            "to_port_name as to_port",
            "to_un_locode as to_locode",
            "to_country_code as to_country",
            "distance_nm",
            "typical_days",
            f"{half_up(ratio('distance_nm', 'typical_days'), 0)} as avg_speed_nm_per_day",
        )
    )


KPIS = {
    "busiest_ports": busiest_ports,
    "avg_delay_by_route": avg_delay_by_route,
    "leg_distances": leg_distances,
}
