"""Ranking, numbering, neighbour and running-total analyses.

Windows over facts go through ``seaflow.functions.spread``, which cuts oversized groups; windows over monthly
totals are plain, since their groups hold at most twelve rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from seaflow.functions import spread
from seaflow.functions.measures import exact_sum, totals
from seaflow.operators.network import legs_with_ports
from seaflow.sources.tables import FreightTables


def delay_rank_at_port(t: FreightTables, split_rows: int = spread.SPLIT_ROWS) -> DataFrame:
    """Rank of every late stop among the late stops of its port, worst delay first."""
    ranked = spread.ranked(
        t.voyage_stop.filter("delay_hours > 0").select("voyage_id", "port_id", "eta", "ata", "delay_hours"),
        keys=["port_id"],
        value="delay_hours",
        levels=None,
        name="delay_rank_at_port",
        split_rows=split_rows,
    )
    return (
        ranked.join(t.voyage.select("voyage_id", "voyage_number"), "voyage_id")
        .join(t.port.select("port_id", "port_name"), "port_id")
        .select("port_name", "voyage_number", "eta", "ata", "delay_hours", "delay_rank_at_port")
        .orderBy("port_name", "delay_rank_at_port", "voyage_number", "eta")
    )


def revenue_rank_in_country(t: FreightTables, split_rows: int = spread.SPLIT_ROWS) -> DataFrame:
    """Dense rank of the customers of a country by revenue."""
    revenue = totals(t.shipment, ["customer_id"], f"{exact_sum('total_value_usd')} as revenue").join(
        t.customer.select("customer_id", "country_code", "company_name"), "customer_id"
    )
    ranked = spread.ranked(
        revenue,
        keys=["country_code"],
        value="revenue",
        levels=None,
        name="revenue_rank_in_country",
        dense=True,
        split_rows=split_rows,
        sizes=spread.group_sizes(t.customer, "country_code"),
    )
    return ranked.selectExpr(
        "country_code", "company_name", "cast(revenue as double) as total_revenue_usd", "revenue_rank_in_country"
    ).orderBy("country_code", "revenue_rank_in_country", "company_name")


def booking_sequence(t: FreightTables, split_rows: int = spread.SPLIT_ROWS) -> DataFrame:
    """Number the bookings of each customer in order of time; equal times follow the shipment key."""
    numbered = spread.numbered(
        t.shipment.select("shipment_id", "customer_id", "bl_number", "booking_date", "total_value_usd"),
        keys=["customer_id"],
        order=["booking_date", "shipment_id"],
        levels=None,
        name="booking_sequence",
        split_rows=split_rows,
    )
    return (
        numbered.join(t.customer.select("customer_id", "company_name"), "customer_id")
        .select("company_name", "bl_number", "booking_date", "total_value_usd", "booking_sequence")
        .orderBy("company_name", "booking_sequence")
    )


def delay_change(t: FreightTables, split_rows: int = spread.SPLIT_ROWS) -> DataFrame:
    """Delay at each stop next to that of the previous stop; the first stop is compared with zero."""
    stops = spread.neighbour(
        t.voyage_stop.select("voyage_id", "port_id", "stop_sequence", "delay_hours"),
        keys=["voyage_id"],
        order=["stop_sequence"],
        levels={"_block": spread.block("stop_sequence")},
        values=["delay_hours"],
        name="previous",
        split_rows=split_rows,
    )
    return (
        stops.join(t.voyage.select("voyage_id", "voyage_number"), "voyage_id")
        .join(t.port.select("port_id", "port_name"), "port_id")
        .selectExpr(
            "voyage_number",
            "stop_sequence",
            "port_name",
            "delay_hours as current_delay_h",
            "previous.delay_hours as prev_stop_delay_h",
            "delay_hours - if(previous is null, 0e0, previous.delay_hours) as delay_change_h",
        )
        .orderBy("voyage_number", "stop_sequence")
    )


def next_leg(t: FreightTables, split_rows: int = spread.SPLIT_ROWS) -> DataFrame:
    """Distance and destination of the leg that follows on the same route."""
    legs = spread.neighbour(
        legs_with_ports(t, "port_name"),
        keys=["route_id"],
        order=["leg_sequence"],
        levels={"_block": spread.block("leg_sequence")},
        values=["distance_nm", "to_port_name"],
        name="following",
        following=True,
        split_rows=split_rows,
        sizes=spread.group_sizes(t.route_leg, "route_id"),
    )
    return legs.selectExpr(
        "route_name",
        "leg_sequence",
        "from_port_name as from_port",
        "to_port_name as to_port",
        "distance_nm",
        "following.distance_nm as next_leg_nm",
        "following.to_port_name as next_destination",
    ).orderBy("route_name", "leg_sequence")


def year_to_date(t: FreightTables) -> DataFrame:
    """Bookings and revenue per month with running totals within the year."""
    bookings = t.shipment.selectExpr(
        "left(cast(booking_date as string), 4) as booking_year",
        "substr(cast(booking_date as string), 6, 2) as booking_month",
        "total_value_usd",
    )
    monthly = totals(
        bookings,
        ["booking_year", "booking_month"],
        "count(*) as shipments_booked",
        f"{exact_sum('total_value_usd')} as revenue",
    )
    so_far = (
        "over (partition by booking_year order by booking_month rows between unbounded preceding and current row)"
    )
    return monthly.selectExpr(
        "booking_year",
        "booking_month",
        "shipments_booked",
        "cast(revenue as double) as monthly_revenue_usd",
        f"sum(shipments_booked) {so_far} as ytd_shipment_count",
        f"cast(sum(revenue) {so_far} as double) as ytd_revenue_usd",
    ).orderBy("booking_year", "booking_month")
