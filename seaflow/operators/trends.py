"""Congestion, punctuality, concentration, utilisation and revenue trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions import spread
from seaflow.functions.measures import (
    exact_sum,
    exact_total,
    half_up,
    load_band,
    percent,
    ratio,
    tally,
    totals,
)
from seaflow.operators.network import port_role
from seaflow.sources.tables import FreightTables


def port_congestion(t: FreightTables) -> DataFrame:
    """Share of delayed calls and delay per call for every port."""
    calls = totals(
        t.voyage_stop,
        ["port_id"],
        "count(*) as calls",
        f"{tally('delay_hours > 0')} as delayed",
        f"{exact_sum('delay_hours')} as delay",
    )
    return (
        t.port.join(calls, "port_id", "left")
        .selectExpr(
            "un_locode",
            "port_name",
            "country_code",
            "is_transshipment",
            "coalesce(calls, 0) as total_vessel_calls",
            "coalesce(delayed, 0) as delayed_calls",
            f"{percent('delayed', 'calls')} as pct_delayed",
            f"{half_up(ratio('delay', 'calls'), 2)} as avg_delay_hours",
            f"{half_up('delay', 2)} as total_delay_hours",
            f"{half_up(ratio('delay', 'calls'), 2)} as congestion_index",
        )
        .orderBy(F.desc("congestion_index"), "un_locode")
    )


def lane_punctuality(t: FreightTables) -> DataFrame:
    """Arrived shipments per country pair and the share whose voyage had no delay at its last stop."""
    final = totals(t.voyage_stop, ["voyage_id"], "max_by(delay_hours, stop_sequence) as final_delay")
    # Shipments are counted per voyage and port pair first, so a busy voyage is one row in the join.
    arrived = totals(
        t.shipment.filter("status in ('Arrived', 'Delivered')"),
        ["voyage_id", "origin_port_id", "dest_port_id"],
        "count(*) as n",
    )
    lanes = totals(
        arrived.join(final, "voyage_id")
        .join(port_role(t, "origin", "country_code"), "origin_port_id")
        .join(port_role(t, "dest", "country_code"), "dest_port_id"),
        ["origin_country_code", "dest_country_code"],
        "sum(n) as shipments_measured",
        "sum(if(final_delay = 0, n, 0)) as on_time",
        "sum(cast(final_delay as decimal(20,6)) * n) as delay",
    )
    return lanes.selectExpr(
        "origin_country_code || ' -> ' || dest_country_code as trade_lane",
        "shipments_measured",
        "on_time",
        f"{percent('on_time', 'shipments_measured')} as otp_pct",
        f"{half_up(ratio('delay', 'shipments_measured'), 2)} as avg_final_delay_hours",
    ).orderBy("otp_pct", "trade_lane")


def value_concentration(t: FreightTables, split_rows: int = spread.SPLIT_ROWS) -> DataFrame:
    """Customers by revenue with their share and the cumulative share of the total.

    The running total has no partition key; beyond ``split_rows`` customers it is cut by revenue.
    """
    spent = totals(
        t.shipment, ["customer_id"], "count(*) as shipment_count", f"{exact_sum('total_value_usd')} as revenue"
    )
    grand = totals(t.shipment, [], f"{exact_total('total_value_usd')} as grand_total")
    summed = spread.running(
        spent.join(t.customer.select("customer_id", "company_name", "industry", "country_code"), "customer_id"),
        keys=[],
        order=["revenue desc", "customer_id"],
        levels=None,
        amount="revenue",
        name="so_far",
        split_rows=split_rows,
        sizes=spread.group_sizes(t.customer),
    )
    return (
        summed.crossJoin(F.broadcast(grand))
        .selectExpr(
            "company_name",
            "industry",
            "country_code",
            "shipment_count",
            "cast(revenue as double) as customer_revenue_usd",
            f"{percent('revenue', 'grand_total', 2)} as pct_of_total",
            f"{percent('so_far', 'grand_total', 2)} as cumulative_pct",
        )
        .orderBy(F.desc("customer_revenue_usd"), "company_name")
    )


def voyage_load(t: FreightTables) -> DataFrame:
    """Weight loaded per voyage against the gross tonnage of its vessel, with a load band."""
    loaded = totals(t.shipment, ["voyage_id"], "count(*) as n", f"{exact_total('total_weight_kg')} as kg")
    return (
        t.voyage.join(loaded, "voyage_id", "left")
        .join(t.vessel.select("vessel_id", "vessel_name", "vessel_type", "gross_tonnage"), "vessel_id")
        .selectExpr(
            "voyage_number",
            "departure_date",
            "status",
            "vessel_name",
            "vessel_type",
            "gross_tonnage as capacity_kg",
            "coalesce(n, 0) as shipment_count",
            "kg as loaded_weight_kg",
            f"{percent('kg', 'gross_tonnage')} as utilisation_pct",
            f"{load_band(ratio('kg', 'gross_tonnage'))} as load_band",
        )
        .orderBy(F.desc("utilisation_pct"), "voyage_number")
    )


def monthly_revenue(t: FreightTables) -> DataFrame:
    """Booked revenue per month (cancellations left out), mean of three rows, and running total.

    One row per month remains before the windows, so they may run in a single task.
    """
    bookings = t.shipment.filter("status <> 'Cancelled'").selectExpr(
        "left(cast(booking_date as string), 7) as month", "total_value_usd"
    )
    monthly = totals(
        bookings, ["month"], "count(*) as new_shipments", f"{exact_sum('total_value_usd')} as revenue"
    )
    last_three = "over (order by month rows between 2 preceding and current row)"
    so_far = "over (order by month rows between unbounded preceding and current row)"
    rolling = f"(cast(sum(revenue) {last_three} as double) / count(revenue) {last_three})"
    return monthly.selectExpr(
        "month",
        "new_shipments",
        "cast(revenue as double) as booked_revenue_usd",
        f"{half_up(rolling, 2)} as rolling_3m_avg_usd",
        f"cast(sum(revenue) {so_far} as double) as cumulative_revenue_usd",
    ).orderBy("month")


def delay_by_vessel(t: FreightTables, split_rows: int = spread.SPLIT_ROWS) -> DataFrame:
    """Delay per vessel, densely ranked by the unrounded mean."""
    per_voyage = totals(
        t.voyage_stop,
        ["voyage_id"],
        "count(*) as calls",
        f"{exact_sum('delay_hours')} as delay",
        "max(delay_hours) as worst",
    )
    per_vessel = totals(
        t.voyage.select("voyage_id", "vessel_id").join(per_voyage, "voyage_id"),
        ["vessel_id"],
        "count(*) as total_voyages",
        "sum(calls) as total_port_calls",
        "max(worst) as worst",
        "sum(delay) as delay",
        # Decimal division, so that equal means tie however they come about.
        "cast(sum(delay) as decimal(24,4)) / cast(sum(calls) as decimal(12,0)) as mean_delay",
    )
    ranked = spread.ranked(
        per_vessel.join(
            t.vessel.select("vessel_id", "vessel_name", "vessel_type", "flag_state", "operator"), "vessel_id"
        ),
        keys=[],
        value="mean_delay",
        levels=None,
        name="delay_rank",
        dense=True,
        split_rows=split_rows,
        sizes=spread.group_sizes(t.vessel),
    )
    return ranked.selectExpr(
        "vessel_name",
        "vessel_type",
        "flag_state",
        "operator",
        "total_voyages",
        "total_port_calls",
        f"{half_up('cast(mean_delay as double)', 2)} as avg_delay_hours",
        f"{half_up('worst', 2)} as worst_delay_hours",
        f"{half_up('delay', 2)} as cumulative_delay_hours",
        "delay_rank",
    ).orderBy(F.desc("avg_delay_hours"), "vessel_name")
