"""Data behind the dashboard's charts, tiles and filters, in the long form a chart library takes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import half_up, totals
from seaflow.operators.commercial import (
    revenue_by_trade_lane,
    shipment_status_breakdown,
    top_customers_by_value,
)
from seaflow.operators.fleet import vessel_utilization
from seaflow.operators.network import avg_delay_by_route, busiest_ports
from seaflow.operators.operations import on_time_performance
from seaflow.operators.tracking import Lookup, listed_shipments, located_events, port_volume, shipment_list
from seaflow.sources.tables import FreightTables

PALETTE_SIZE = 10

# Fixed colours of the statuses; any other status is grey.
STATUS_COLORS = {
    "Scheduled": "#bdc3c7",
    "Departed": "#2980b9",
    "In Transit": "#e8673c",
    "Arrived": "#27ae60",
    "Completed": "#1a3a5c",
    "Booked": "#bdc3c7",
    "Loaded": "#2980b9",
    "Delivered": "#27ae60",
    "Cancelled": "#c0392b",
}
OTHER_COLOR = "#7f8c8d"


def _millions(value: str) -> str:
    """``$12.3 M``"""
    return f"format_string('$%.1f M', {half_up(f'({value} / 1e6)', 1)})"


def marker_sizes(t: FreightTables) -> DataFrame:
    """Marker size per port, scaled by calls among hubs and among other ports separately."""
    ports = port_volume(t).select("port_id", "port_name", "is_transshipment", "total_calls")
    spans = totals(ports, ["is_transshipment"], "min(total_calls) as least", "max(total_calls) as most")
    return ports.join(spans, "is_transshipment").selectExpr(
        "port_id",
        "port_name",
        "is_transshipment",
        "total_calls",
        "coalesce(8e0 + (total_calls - least) * 28e0 / greatest(1, most - least), 10e0) as marker_size",
    )


def delay_series(t: FreightTables) -> DataFrame:
    """Mean delay, worst delay and punctuality of each route as series, least delayed route first."""
    routes = avg_delay_by_route(t).selectExpr(
        "route_name",
        "avg_delay_h as sort_key",
        "avg_delay_h as `Avg delay (h)`",
        "max_delay_h as `Max delay (h)`",
        "otp_pct as `OTP %`",
    )
    series = ["Avg delay (h)", "Max delay (h)", "OTP %"]
    return (
        routes.unpivot(["route_name", "sort_key"], series, "series", "value")
        .filter("value is not null")
        .orderBy("sort_key", "route_name", "series")
        .drop("sort_key")
    )


def punctuality_bands(t: FreightTables) -> DataFrame:
    """Stops per band; severe delays are taken out of the delayed ones."""
    return on_time_performance(t).selectExpr(
        """stack(4,
            'On time (≤ 4 h)', coalesce(on_time, 0),
            'Delayed (4–24 h)', greatest(0, coalesce(delayed, 0) - coalesce(severely_delayed, 0)),
            'Severely delayed (> 24 h)', coalesce(severely_delayed, 0),
            'Pending', coalesce(pending_stops, 0)) as (band, stops)"""
    )


def voyage_status_series(t: FreightTables) -> DataFrame:
    """Voyages per vessel and state."""
    return vessel_utilization(t).selectExpr(
        "vessel_name",
        "stack(4, 'Completed', completed, 'Active', active, 'Arrived', arrived, 'Scheduled', scheduled) "
        "as (state, voyages)",
    )


def top_customers(t: FreightTables, top_n: int = 10) -> DataFrame:
    """The customers of highest value, least valuable first as a bar chart draws them.

    Industries get a colour number in the order in which they appear; the windows see ``top_n`` rows.
    """
    return (
        top_customers_by_value(t)
        .select("company_name", "industry", "total_value_usd")
        .orderBy(F.desc("total_value_usd"), "company_name")
        .limit(top_n)
        .selectExpr("*", "min(total_value_usd) over (partition by industry) as lowest")
        .selectExpr(
            "* except (lowest)",
            f"cast((dense_rank() over (order by lowest, industry) - 1) % {PALETTE_SIZE} as bigint) as color_index",
        )
        .orderBy("total_value_usd", F.desc("company_name"))
    )


def lane_labels(t: FreightTables) -> DataFrame:
    """Lanes with the label of their tile."""
    return revenue_by_trade_lane(t).selectExpr(
        f"route_name || '<br>' || {_millions('total_value_usd')} as label",
        "total_value_usd",
        "shipment_count",
        "customer_count",
        "avg_value_usd",
        "service_name",
    )


def status_chart(t: FreightTables) -> DataFrame:
    """Count and value per status with colour and label, lowest value first."""
    colours = " ".join(f"when '{status}' then '{code}'" for status, code in STATUS_COLORS.items())
    return (
        shipment_status_breakdown(t)
        .selectExpr(
            "status",
            "shipment_count",
            "total_value_usd",
            f"case status {colours} else '{OTHER_COLOR}' end as color",
            f"{_millions('total_value_usd')} as label",
        )
        .orderBy("total_value_usd")
    )


def event_pins(t: FreightTables, bl: Lookup = None) -> DataFrame:
    """Events with a position; event types are numbered per shipment by first appearance, for the palette.

    Only the first time of each type of a shipment enters the window, so a group holds the event types at most.
    """
    placed = located_events(t, bl).filter("latitude is not null and longitude is not null")
    first = totals(placed, ["bl_number", "event_type"], "min(struct(event_timestamp, event_id)) as at")
    position = "row_number() over (partition by bl_number order by at) - 1"
    numbered = first.selectExpr(
        "bl_number", "event_type", f"cast(({position}) % {PALETTE_SIZE} as bigint) as color_index"
    )
    return placed.join(numbered, ["bl_number", "event_type"]).select(
        "bl_number", "event_id", "event_type", "event_timestamp", "port_name", "latitude", "longitude", "color_index"
    )


def kpi_tiles(t: FreightTables) -> DataFrame:
    """The figures of the overview tiles, as one row."""
    fleet = totals(
        vessel_utilization(t),
        [],
        "coalesce(sum(active), 0) as active_voyages",
        "coalesce(sum(scheduled), 0) as scheduled_voyages",
    )
    shipments = totals(
        t.shipment, [], "count(*) as total_shipments", "count_if(status = 'In Transit') as in_transit"
    )
    punctuality = on_time_performance(t).selectExpr(
        "coalesce(otp_pct, 0e0) as otp_pct",
        "coalesce(avg_delay_h, 0e0) as avg_delay_h",
        "coalesce(severely_delayed, 0) as severely_delayed",
    )
    best = "min_by(struct(route_name, total_value_usd), struct(-total_value_usd, route_name)) as lane"
    lane = totals(revenue_by_trade_lane(t), [], best).selectExpr(
        "coalesce(lane.route_name, 'N/A') as top_lane", "coalesce(lane.total_value_usd, 0e0) as top_lane_value_usd"
    )
    # Four frames of one row each.
    return fleet.crossJoin(F.broadcast(shipments)).crossJoin(F.broadcast(punctuality)).crossJoin(F.broadcast(lane))


def insights(t: FreightTables) -> DataFrame:
    """The statements of the overview as rows ``(insight, subject, detail, value)``."""

    def row(df: DataFrame, name: str, subject: str, detail: str, value: str) -> DataFrame:
        return df.selectExpr(
            f"'{name}' as insight",
            f"cast({subject} as string) as subject",
            f"cast({detail} as string) as detail",
            f"cast({value} as double) as value",
        )

    def first(df: DataFrame, value: str, name: str) -> DataFrame:
        return df.orderBy(F.desc(value), name).limit(1)

    lanes = totals(
        revenue_by_trade_lane(t),
        [],
        "count(*) as lanes",
        "cast(sum(cast(total_value_usd as decimal(38,2))) as double) as revenue",
    ).filter("lanes > 0")
    lane_rows = lanes.selectExpr(
        "stack(2, 'trade lanes', cast(lanes as double), 'booked revenue', revenue) as (insight, value)"
    )
    severe = on_time_performance(t).filter("severely_delayed > 0")
    parts = [
        row(first(busiest_ports(t), "total_calls", "un_locode"), "busiest port", "port_name", "un_locode", "total_calls"),
        row(first(avg_delay_by_route(t), "avg_delay_h", "route_name"), "worst route", "route_name", "null", "avg_delay_h"),
        row(
            first(top_customers_by_value(t), "total_value_usd", "company_name"),
            "top customer",
            "company_name",
            "industry",
            "total_value_usd",
        ),
        lane_rows.selectExpr("insight", "cast(null as string) as subject", "cast(null as string) as detail", "value"),
        row(severe, "severe delays", "null", "null", "severely_delayed"),
    ]
    return reduce(DataFrame.unionByName, parts)


def filter_options(t: FreightTables) -> DataFrame:
    """Values the list filters offer: each is reduced to what is distinct before it meets another table.

    A status is offered even where the references of its shipments lead nowhere.
    """
    statuses = t.shipment.select("status").distinct().selectExpr("'status' as filter", "status as value")
    lanes = (
        t.shipment.select("voyage_id")
        .distinct()
        .join(t.voyage.select("voyage_id", "route_id"), "voyage_id")
        .select("route_id")
        .distinct()
        .join(t.route.select("route_id", "route_name"), "route_id")
        .selectExpr("'trade_lane' as filter", "route_name as value")
        .distinct()
    )
    return statuses.unionByName(lanes).filter("value is not null").orderBy("filter", "value")


def filtered_list(
    t: FreightTables,
    statuses: list[str] | None = None,
    lanes: list[str] | None = None,
    bl_prefix: str = "",
) -> DataFrame:
    """The shipment list narrowed by status, lane and start of the bill of lading; None selects all."""
    listed = shipment_list(t)
    if statuses is not None:
        listed = listed.filter(F.col("status").isin(statuses))
    if lanes is not None:
        listed = listed.filter(F.col("trade_lane").isin(lanes))
    prefix = bl_prefix.strip().upper()
    return listed.filter(F.col("bl_number").startswith(prefix)) if prefix else listed
