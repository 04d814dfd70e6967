"""Commercial KPIs: customers, trade lanes, shipment states and refrigerated cargo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import exact_mean, exact_sum, exact_total, half_up, percent, tally, totals
from seaflow.operators.network import port_role
from seaflow.sources.tables import FreightTables

_VALUE = f"{exact_total('total_value_usd')} as total_value_usd"
_WEIGHT = f"{exact_total('total_weight_kg')} as total_weight_kg"
_MEAN_VALUE = half_up(exact_mean("total_value_usd"), 2)
_MEAN_WEIGHT = half_up(exact_mean("total_weight_kg"), 2)


def top_customers_by_value(t: FreightTables) -> DataFrame:
    """Value and weight shipped per customer, with the voyages and shipment states seen.

    The states are a set bounded by their domain, kept while the rows are folded; a second COUNT DISTINCT in the same
    aggregate would multiply all rows before the shuffle.
    """
    shipped = totals(
        t.shipment,
        ["customer_id"],
        "count(*) as shipment_count",
        _VALUE,
        f"{_MEAN_VALUE} as avg_shipment_value_usd",
        _WEIGHT,
        "count(distinct voyage_id) as voyages_used",
        "cast(size(collect_set(status)) as bigint) as status_variety",
    )
    return (
        t.customer.select("customer_id", "company_name", "country_code", "industry")
        .join(shipped, "customer_id")
        .orderBy(F.desc("total_value_usd"), "customer_id")
        .drop("customer_id")
    )


def revenue_by_trade_lane(t: FreightTables) -> DataFrame:
    """Shipments, customers, value and weight per route.

    Shipments are first summed per voyage and customer, so the join to the voyages and the distinct count of
    customers run on reduced rows.
    """
    per_voyage = totals(
        t.shipment,
        ["voyage_id", "customer_id"],
        "count(*) as n",
        "count(total_value_usd) as n_value",
        "count(total_weight_kg) as n_weight",
        f"{exact_sum('total_value_usd')} as usd",
        f"{exact_sum('total_weight_kg')} as kg",
    )
    per_route = totals(
        t.voyage.select("voyage_id", "route_id").join(per_voyage, "voyage_id"),
        ["route_id"],
        "sum(n) as shipment_count",
        "count(distinct customer_id) as customer_count",
        "cast(sum(usd) as double) as usd",
        "cast(sum(kg) as double) as kg",
        "sum(n_value) as n_value",
        "sum(n_weight) as n_weight",
    )
    return (
        t.route.join(per_route, "route_id")
        .join(port_role(t, "origin", "port_name"), "origin_port_id")
        .join(port_role(t, "dest", "port_name"), "dest_port_id")
        .selectExpr(
            "route_name",
            "service_name",
            "origin_port_name as origin_port",
            "dest_port_name as dest_port",
            "shipment_count",
            "customer_count",
            "usd as total_value_usd",
            f"{half_up('usd / nullif(n_value, 0)', 2)} as avg_value_usd",
            "kg as total_weight_kg",
            f"{half_up('kg / nullif(n_weight, 0)', 2)} as avg_weight_kg",
        )
        .orderBy(F.desc("total_value_usd"), "route_name")
    )


def shipment_status_breakdown(t: FreightTables) -> DataFrame:
    """Shipments per status with their share of all shipments (a window over the few grouped rows)."""
    by_status = totals(
        t.shipment,
        ["status"],
        "count(*) as shipment_count",
        _VALUE,
        f"{_MEAN_VALUE} as avg_value_usd",
        _WEIGHT,
        f"{_MEAN_WEIGHT} as avg_weight_kg",
    )
    return by_status.selectExpr(
        "status",
        "shipment_count",
        f"{percent('shipment_count', 'sum(shipment_count) over ()')} as pct_of_total",
        "total_value_usd",
        "avg_value_usd",
        "total_weight_kg",
        "avg_weight_kg",
    ).orderBy(F.desc("shipment_count"), "status")


_COLD = "case when is_reefer = 1 then temperature_c end"
_MEAN_TEMPERATURE = half_up(exact_mean(_COLD), 1)
_LEAST_TEMPERATURE, _GREATEST_TEMPERATURE = half_up(f"min({_COLD})", 1), half_up(f"max({_COLD})", 1)


def reefer_by_type(t: FreightTables) -> DataFrame:
    """Refrigerated and dry containers per type, with the temperatures of the refrigerated ones."""
    return totals(
        t.container,
        ["container_type"],
        "count(*) as total_containers",
        "sum(is_reefer) as reefer_count",
        f"{tally('is_reefer = 0')} as dry_count",
        f"{percent('sum(is_reefer)', 'count(*)')} as reefer_pct",
        f"{_MEAN_TEMPERATURE} as avg_temp_c",
        f"{_LEAST_TEMPERATURE} as min_temp_c",
        f"{_GREATEST_TEMPERATURE} as max_temp_c",
    ).orderBy(F.desc("total_containers"), "container_type")


def reefer_summary(t: FreightTables) -> DataFrame:
    """The same over all containers, as one row."""
    return totals(
        t.container,
        [],
        "count(*) as total_containers",
        "sum(is_reefer) as reefer_containers",
        f"{tally('is_reefer = 0')} as dry_containers",
        f"{percent('sum(is_reefer)', 'count(*)')} as reefer_pct",
        f"{_MEAN_TEMPERATURE} as avg_reefer_temp_c",
        f"{_LEAST_TEMPERATURE} as min_temp_c",
        f"{_GREATEST_TEMPERATURE} as max_temp_c",
    )


KPIS = {
    "top_customers_by_value": top_customers_by_value,
    "revenue_by_trade_lane": revenue_by_trade_lane,
    "shipment_status_breakdown": shipment_status_breakdown,
    "reefer_by_type": reefer_by_type,
    "reefer_summary": reefer_summary,
}
