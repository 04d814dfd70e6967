"""Operations KPIs: punctuality of the fleet, its voyages and its ports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import (
    ARRIVED,
    LATE,
    ON_TIME,
    OVER_A_DAY,
    SEVERE_LIMIT_H,
    SEVERELY_LATE,
    exact_mean,
    exact_sum,
    half_up,
    percent,
    tally,
    totals,
)
from seaflow.sources.tables import FreightTables

_ARRIVED_MEAN = exact_mean(f"case when {ARRIVED} then delay_hours end")


def on_time_performance(t: FreightTables) -> DataFrame:
    """One row for the whole fleet. Late stops include the severely late ones."""
    return totals(
        t.voyage_stop,
        [],
        "count(*) as total_stops",
        f"{tally(ARRIVED)} as completed_stops",
        f"{tally('ata is null')} as pending_stops",
        f"{tally(ON_TIME)} as on_time",
        f"{tally(LATE)} as delayed",
        f"{tally(SEVERELY_LATE)} as severely_delayed",
        f"{percent(tally(ON_TIME), tally(ARRIVED))} as otp_pct",
        f"{half_up(_ARRIVED_MEAN, 2)} as avg_delay_h",
        f"{half_up('max(delay_hours)', 2)} as max_delay_h",
    )


def delayed_voyages(t: FreightTables) -> DataFrame:
    """Voyages whose stops add up to more than a day of delay; reduced before any other table is touched."""
    late_voyages = totals(
        t.voyage_stop,
        ["voyage_id"],
        "count(*) as stop_count",
        f"{exact_sum('delay_hours')} as delay",
        f"{half_up(exact_mean('delay_hours'), 2)} as avg_delay_h",
        f"{half_up('max(delay_hours)', 2)} as max_stop_delay_h",
        f"{tally(OVER_A_DAY)} as stops_over_24h",
    ).filter(f"delay > {SEVERE_LIMIT_H}")
    return (
        t.voyage.join(late_voyages, "voyage_id")
        .join(t.vessel.select("vessel_id", "vessel_name", "operator"), "vessel_id")
        .join(t.route.select("route_id", "route_name"), "route_id")
        .selectExpr(
            "voyage_number",
            "status",
            "vessel_name",
            "operator",
            "route_name",
            "departure_date",
            "arrival_date",
            "stop_count",
            f"{half_up('delay', 2)} as total_delay_h",
            "avg_delay_h",
            "max_stop_delay_h",
            "stops_over_24h",
        )
        .orderBy(F.desc("total_delay_h"), "voyage_number")
    )


def avg_delay_by_port(t: FreightTables) -> DataFrame:
    """Delay profile of every port called at; the mean covers arrived calls, the maximum all calls."""
    calls = totals(
        t.voyage_stop,
        ["port_id"],
        "count(*) as total_calls",
        f"{tally(ARRIVED)} as arrived_calls",
        f"{half_up(_ARRIVED_MEAN, 2)} as avg_delay_h",
        f"{half_up('max(delay_hours)', 2)} as max_delay_h",
        f"{tally(LATE)} as delayed_arrivals",
        f"{tally(SEVERELY_LATE)} as severe_delays",
        f"{percent(tally(ON_TIME), tally(ARRIVED))} as otp_pct",
    )
    return (
        t.port.drop("timezone")
        .join(calls, "port_id")
        .drop("port_id")
        .orderBy(F.desc_nulls_last("avg_delay_h"), "un_locode")
    )


KPIS = {
    "on_time_performance": on_time_performance,
    "delayed_voyages": delayed_voyages,
    "avg_delay_by_port": avg_delay_by_port,
}
