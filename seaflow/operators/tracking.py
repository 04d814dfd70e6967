"""Shipment lists and look-ups by bill of lading, and the two map layers of the network.

A look-up takes one number, a DataFrame with a ``bl_number`` column (a semi-join, the form for many look-ups at
once), or None for every shipment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import exact_total, half_up, totals
from seaflow.operators.network import legs_with_ports, port_calls, port_role
from seaflow.sources.tables import FreightTables

Lookup = str | DataFrame | None


def shipments_of(t: FreightTables, bl: Lookup) -> DataFrame:
    """The shipments asked for; typed numbers are trimmed and upper-cased, as a search box does."""
    if bl is None:
        return t.shipment
    if isinstance(bl, DataFrame):
        return t.shipment.join(bl.select("bl_number"), "bl_number", "left_semi")
    return t.shipment.filter(F.col("bl_number") == bl.strip().upper())


def _joined(shipments: DataFrame, *dimensions: tuple[DataFrame, str]) -> DataFrame:
    for dimension, key in dimensions:
        shipments = shipments.join(dimension, key)
    return shipments


def listed_shipments(t: FreightTables) -> DataFrame:
    """All shipments with customer, lane and ports, in no particular order."""
    return _joined(
        t.shipment,
        (t.customer.select("customer_id", "company_name"), "customer_id"),
        (t.voyage.selectExpr("voyage_id", "route_id", "status as voyage_status"), "voyage_id"),
        (t.route.select("route_id", "route_name"), "route_id"),
        (port_role(t, "origin", "un_locode"), "origin_port_id"),
        (port_role(t, "dest", "un_locode"), "dest_port_id"),
    ).selectExpr(
        "bl_number",
        "company_name as customer",
        "route_name as trade_lane",
        "origin_un_locode as origin",
        "dest_un_locode as destination",
        "incoterms",
        "status",
        "voyage_status",
        "booking_date",
        f"{half_up('total_weight_kg', 0)} as weight_kg",
        f"{half_up('total_value_usd', 0)} as value_usd",
    )


def shipment_list(t: FreightTables) -> DataFrame:
    """All shipments, newest booking first."""
    return listed_shipments(t).orderBy(F.desc("booking_date"), "bl_number")


def shipment_page(t: FreightTables, size: int, after: tuple[str | None, str] | None = None) -> DataFrame:
    """``size`` shipments of the list, from the one that follows ``after`` on: booking date and number of the last one of
    the page before.

    What was seen is a filter on the stored columns, and each task keeps ``size`` rows: no page sorts all shipments.
    Shipments without booking date are the last.
    """
    listed = listed_shipments(t)
    if after is not None:
        date, bl = after
        if date is None:
            listed = listed.filter(F.col("booking_date").isNull() & (F.col("bl_number") > bl))
        else:
            moment = F.lit(date).cast("timestamp_ntz")
            same = (F.col("booking_date") == moment) & (F.col("bl_number") > bl)
            listed = listed.filter((F.col("booking_date") < moment) | same | F.col("booking_date").isNull())
    return listed.orderBy(F.desc("booking_date"), "bl_number").limit(size)


def shipment_detail(t: FreightTables, bl: Lookup = None) -> DataFrame:
    """Header of each shipment: customer, voyage, route and ports."""
    return _joined(
        shipments_of(t, bl),
        (t.customer.select("customer_id", "company_name", "industry"), "customer_id"),
        (t.voyage.withColumnRenamed("status", "voyage_status"), "voyage_id"),
        (t.route.select("route_id", "route_name"), "route_id"),
        (port_role(t, "origin", "port_name", "un_locode"), "origin_port_id"),
        (port_role(t, "dest", "port_name", "un_locode"), "dest_port_id"),
    ).selectExpr(
        "bl_number",
        "status",
        "incoterms",
        "booking_date",
        "total_weight_kg",
        "total_value_usd",
        "company_name",
        "industry",
        "voyage_number",
        "departure_date",
        "arrival_date",
        "voyage_status",
        "route_name",
        "origin_port_name as origin_port",
        "origin_un_locode as origin_locode",
        "dest_port_name as dest_port",
        "dest_un_locode as dest_locode",
    )


def shipment_meta(t: FreightTables, bl: Lookup = None) -> DataFrame:
    """The short header shown above a shipment map."""
    return _joined(
        shipments_of(t, bl),
        (t.customer.select("customer_id", "company_name"), "customer_id"),
        (t.voyage.select("voyage_id", "route_id", "voyage_number"), "voyage_id"),
        (t.route.select("route_id", "route_name"), "route_id"),
    ).select("bl_number", "status", "incoterms", "total_value_usd", "company_name", "voyage_number", "route_name")


def located_events(t: FreightTables, bl: Lookup = None) -> DataFrame:
    """Tracking events with port and coordinates where a port is known, in no particular order."""
    return (
        t.shipment_event.join(shipments_of(t, bl).select("shipment_id", "bl_number"), "shipment_id")
        .join(t.port.select("port_id", "un_locode", "port_name", "latitude", "longitude"), "port_id", "left")
        .drop("shipment_id", "port_id")
    )


def event_timeline(t: FreightTables, bl: Lookup = None) -> DataFrame:
    """Tracking events in order of time."""
    return (
        located_events(t, bl)
        .select("bl_number", "event_id", "event_type", "event_timestamp", "port_name", "description")
        .orderBy("bl_number", "event_timestamp", "event_id")
    )


def shipment_containers(t: FreightTables, bl: Lookup = None) -> DataFrame:
    """Containers with number and value of their cargo lines; cargo is summed per container first."""
    wanted = t.container.join(shipments_of(t, bl).select("shipment_id", "bl_number"), "shipment_id")
    lines = t.cargo_item
    if bl is not None:
        lines = lines.join(wanted.select("container_id"), "container_id", "left_semi")
    cargo = totals(lines, ["container_id"], "count(*) as n", f"{exact_total('value_usd')} as usd")
    return (
        wanted.join(cargo, "container_id", "left")
        .selectExpr(
            "bl_number",
            "container_number",
            "container_type",
            "is_reefer",
            "temperature_c",
            "tare_weight_kg",
            "max_payload_kg",
            "coalesce(n, 0) as cargo_items",
            f"{half_up('usd', 0)} as cargo_value_usd",
        )
        .orderBy("bl_number", "container_number")
    )


def shipment_stops(t: FreightTables, bl: Lookup = None) -> DataFrame:
    """Port calls, in sequence, of the voyages that carry the shipments asked for.

    Each call is reported once per voyage, not once per shipment: a voyage with many shipments and many calls would
    otherwise yield their product. ``shipment_meta`` tells which voyage carries a shipment.
    """
    carrying = shipments_of(t, bl).select("voyage_id")
    carrying = carrying.distinct()
    return (
        t.voyage_stop.join(carrying, "voyage_id", "left_semi")
        .join(t.voyage.select("voyage_id", "voyage_number"), "voyage_id")
        .join(t.port.select("port_id", "port_name", "un_locode", "latitude", "longitude"), "port_id")
        .select(
            "voyage_number",
            "stop_sequence",
            "eta",
            "ata",
            "delay_hours",
            "port_name",
            "un_locode",
            "latitude",
            "longitude",
        )
        .orderBy("voyage_number", "stop_sequence")
    )


def port_volume(t: FreightTables) -> DataFrame:
    """Call volume per port with its position, for the network map."""
    return (
        t.port.join(port_calls(t), "port_id", "left")
        .selectExpr(
            "port_id",
            "port_name",
            "un_locode",
            "country_code",
            "latitude",
            "longitude",
            "is_transshipment",
            "coalesce(calls, 0) as total_calls",
            "coalesce(voyages, 0) as distinct_voyages",
            f"{half_up('mean_delay', 1)} as avg_delay_h",
        )
        .orderBy(F.desc("total_calls"), "port_id")
    )


def leg_segments(t: FreightTables) -> DataFrame:
    """End points of every leg, for the network map."""
    return (
        legs_with_ports(t, "latitude", "longitude", "port_name")
        .orderBy("route_id", "leg_sequence")
        .selectExpr(
            "route_name",
            "service_name",
            "leg_sequence",
            "from_latitude as from_lat",
            "from_longitude as from_lon",
            "from_port_name as from_name",
            "to_latitude as to_lat",
            "to_longitude as to_lon",
            "to_port_name as to_name",
            "distance_nm",
        )
    )
