"""Every operator of the library by name, as a function of a session and a source directory."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession

from seaflow.functions.measures import totals
from seaflow.operators import (
    catalog,
    commercial,
    dialogue,
    fleet,
    increments,
    joins,
    loading,
    network,
    operations,
    quality,
    querylog,
    shaping,
    tracking,
    trends,
    windows,
)
from seaflow.sources import fixtures
from seaflow.sources.schema import TABLES
from seaflow.sources.tables import FreightTables, checked, conform

Query = Callable[[SparkSession, str], DataFrame]

VOYAGE_DAYS_SQL = """
    SELECT strftime('%Y-%m', departure_date) AS month, status, COUNT(*) AS voyages,
           SUM(CAST(julianday(arrival_date) - julianday(departure_date) AS BIGINT)) AS days
    FROM VOYAGE
    WHERE status <> ?
    GROUP BY strftime('%Y-%m', departure_date), status
"""
GUARDED_SQL = """
    WITH calls AS (SELECT port_id, COUNT(*) AS n, MAX(delay_hours) AS worst FROM VOYAGE_STOP GROUP BY port_id)
    SELECT p.un_locode, c.n, c.worst FROM calls c JOIN PORT p ON p.port_id = c.port_id LIMIT 5000;
"""
# Texts with the names that SQL lets them see, and texts that reach for a table behind a name seen elsewhere.
GUARD_CASES = {
    "sibling": "WITH a AS (SELECT port_id FROM PORT), b AS (SELECT port_id + 1 AS x FROM a) SELECT SUM(x) AS n FROM b",
    "shadowed": "WITH port AS (SELECT customer_id AS x FROM CUSTOMER) SELECT COUNT(*) AS n FROM port",
    "nested": "WITH a AS (SELECT stop_id AS x FROM VOYAGE_STOP) SELECT MAX(x) AS n FROM "
    "(WITH b AS (SELECT x FROM a) SELECT b.x FROM b JOIN a ON a.x = b.x) y",
    "inner_first": "WITH a AS (SELECT voyage_id AS x FROM VOYAGE) SELECT COUNT(*) AS n FROM "
    "(WITH a AS (SELECT x FROM a WHERE x > 10) SELECT x FROM a) y",
    "subquery": "WITH a AS (SELECT MAX(voyage_id) AS x FROM VOYAGE) SELECT COUNT(*) AS n FROM SHIPMENT "
    "WHERE voyage_id < (SELECT x FROM a)",
    "own_name": "WITH payroll AS (SELECT * FROM payroll) SELECT COUNT(*) AS n FROM payroll",
    "left_scope": "SELECT COUNT(*) AS n FROM (WITH payroll AS (SELECT 1 AS x) SELECT * FROM payroll) a JOIN payroll b ON 1 = 1",
    "later_name": "WITH a AS (SELECT * FROM payroll), payroll AS (SELECT 1 AS x) SELECT COUNT(*) AS n FROM a",
}
SMALL_SPLIT = 2
SINGLE_BL = " bl000000000007"  # as typed into a search box
STALE_AS_OF = "timestamp_ntz'1998-03-01 09:30:00'"
OPEN_STATUSES = ["Booked", "In Transit", "Loaded"]


def _kpi_values(t: FreightTables) -> DataFrame:
    """Every number of every KPI: category, kpi, key (the texts of its row), measure and value."""
    parts = []
    for name in catalog.CATEGORIES:
        for kpi, df in catalog.category(t, name).items():
            texts = [c for c, kind in df.dtypes if kind == "string"]
            measures = [c for c, kind in df.dtypes if kind in ("bigint", "int", "double")]
            stacked = ", ".join(f"'{m}', cast({m} as double)" for m in measures)
            parts.append(
                df.selectExpr(
                    f"'{name}' as category",
                    f"'{kpi}' as kpi",
                    f"concat_ws('|'{''.join(', ' + c for c in texts)}) as key",
                    f"stack({len(measures)}, {stacked}) as (measure, value)",
                )
            )
    return reduce(DataFrame.unionByName, parts)


def _kpi_ranges(t: FreightTables) -> DataFrame:
    """Each measure of each KPI by category: how many values, the least and the greatest."""
    return totals(
        _kpi_values(t),
        ["category", "kpi", "measure"],
        "count(value) as n_values",
        "min(value) as least",
        "max(value) as greatest",
    )


def _load_typed(t: FreightTables) -> DataFrame:
    """Events that arrive without their defaulted column, as text, brought to the declared schema."""
    raw = t.shipment_event.selectExpr("* except (created_by, event_id)", "cast(event_id as string) as event_id")
    return conform(raw, TABLES["shipment_event"])


def _merged_audit(t: FreightTables) -> DataFrame:
    """The audit of all rows from the counts of two batches, into which each table is dealt by its key."""

    def batch(n: int) -> FreightTables:
        mine = f"pmod(xxhash64({{}}), 2) = {n}"
        return FreightTables(t.spark, {name: t.table(name).filter(mine.format(TABLES[name].key)) for name in t.names()})

    first, second = (increments.audit_counts(batch(n)) for n in (0, 1))
    return increments.audit_of(increments.merged_counts(first, second))


def _faulty_events(t: FreightTables) -> tuple[DataFrame, DataFrame]:
    """Events that arrive as text, some with cells that don't fit: those that do, and the others with reasons."""
    raw = t.shipment_event.selectExpr(
        "if(event_id % 13 = 1, 'E' || event_id, cast(event_id as string)) as event_id",
        "cast(shipment_id as string) as shipment_id",
        "if(event_id % 17 = 2, null, event_type) as event_type",
        "if(event_id % 19 = 3, 'yesterday', cast(event_timestamp as string)) as event_timestamp",
        "cast(port_id as string) as port_id",
        "description",
    )
    return checked(raw, TABLES["shipment_event"])


def _load_once(t: FreightTables, prune: bool = False) -> DataFrame:
    """Closed shipments are there already; all shipments then arrive twice."""
    existing = t.shipment.filter("status in ('Arrived', 'Delivered')")
    return loading.load_once(t.shipment.unionByName(t.shipment), existing, ["bl_number"], ["shipment_id"], prune)


def _resolve_keys(t: FreightTables) -> DataFrame:
    """Voyages that name their vessel by IMO number get its key."""
    facts = t.voyage.selectExpr("voyage_number", "'IMO' || lpad(cast(vessel_id as string), 12, '0') as imo_number")
    return loading.resolve_keys(facts, t.vessel, "imo_number", "vessel_id").withColumnRenamed(
        "imo_number_vessel_id", "vessel_id"
    )


def _guarded(t: FreightTables) -> DataFrame:
    outcome = querylog.guarded_query(t, GUARDED_SQL)
    if outcome.result is None:
        raise ValueError("; ".join(outcome.errors))
    return outcome.result


def _guard_cases(t: FreightTables) -> DataFrame:
    """What each text gave, or that it was refused."""
    parts = []
    for name, text in GUARD_CASES.items():
        outcome = querylog.guarded_query(t, text)
        found = outcome.result if outcome.is_valid else t.sql_session().range(1).selectExpr("cast(null as bigint) as n")
        parts.append(found.selectExpr(f"'{name}' as text", f"{int(outcome.is_valid)} as accepted", "cast(n as bigint) as n"))
    return reduce(DataFrame.unionByName, parts)


def _audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = querylog.audit(fixtures.query_log(spark, sf_dir))
    return report.selectExpr(
        "query_id",
        "cast(is_valid as int) as is_valid",
        "sanitized_sql",
        "array_join(errors, ' | ') as errors",
        "array_join(warnings, ' | ') as warnings",
    )


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.source(spark, sf_dir, "conversations")


def _held_bls(t: FreightTables) -> DataFrame:
    """Bills of lading that were held by customs: a look-up given as a frame."""
    held = t.shipment_event.filter("event_type = 'Customs Hold'").select("shipment_id").distinct()
    return t.shipment.join(held, "shipment_id", "left_semi").select("bl_number")


# Operators over the freight tables.
FREIGHT: dict[str, Callable[[FreightTables], DataFrame]] = {
    "k01_vessel_utilization": fleet.vessel_utilization,
    "k02_capacity_vs_booked_teu": fleet.capacity_vs_booked_teu,
    "k03_busiest_ports": network.busiest_ports,
    "k04_avg_delay_by_route": network.avg_delay_by_route,
    "k05_leg_distances": network.leg_distances,
    "k06_on_time_performance": operations.on_time_performance,
    "k07_delayed_voyages": operations.delayed_voyages,
    "k08_avg_delay_by_port": operations.avg_delay_by_port,
    "k09_top_customers_by_value": commercial.top_customers_by_value,
    "k10_revenue_by_trade_lane": commercial.revenue_by_trade_lane,
    "k11_shipment_status_breakdown": commercial.shipment_status_breakdown,
    "k12_reefer_by_type": commercial.reefer_by_type,
    "k13_reefer_summary": commercial.reefer_summary,
    "k14_category_kpis": _kpi_ranges,
    "k15_all_kpis": _kpi_values,
    "k16_run_query": lambda t: t.run_query(VOYAGE_DAYS_SQL, ("Scheduled",)),
    "d01_shipment_list": tracking.shipment_list,
    "d02_shipment_detail": tracking.shipment_detail,
    "d03_event_timeline": tracking.event_timeline,
    "d04_shipment_containers": tracking.shipment_containers,
    "d05_port_volume": tracking.port_volume,
    "d06_leg_segments": tracking.leg_segments,
    "d07_shipment_stops": tracking.shipment_stops,
    "d08_shipment_meta": lambda t: tracking.shipment_meta(t, _held_bls(t)),
    # A page of the list, and the look-ups of one bill of lading.
    "d01_shipment_page": lambda t: tracking.shipment_page(t, 100, ("1996-06-01 00:00:00", "BL")),
    "d02_shipment_detail_single": lambda t: tracking.shipment_detail(t, SINGLE_BL),
    "d03_event_timeline_single": lambda t: tracking.event_timeline(t, SINGLE_BL),
    "d04_shipment_containers_single": lambda t: tracking.shipment_containers(t, SINGLE_BL),
    "d07_shipment_stops_single": lambda t: tracking.shipment_stops(t, SINGLE_BL),
    "d08_shipment_meta_single": lambda t: tracking.shipment_meta(t, SINGLE_BL),
    "j01_in_transit_shipments": joins.in_transit_shipments,
    "j02_route_leg_audit": joins.route_leg_audit,
    "j03_shipment_manifest": joins.shipment_manifest,
    "j04_consecutive_legs": joins.consecutive_legs,
    "j05_above_route_average": joins.above_route_average,
    "j06_voyages_with_customs_hold": joins.voyages_with_customs_hold,
    "w01_delay_rank_at_port": windows.delay_rank_at_port,
    "w02_revenue_rank_in_country": windows.revenue_rank_in_country,
    "w03_booking_sequence": windows.booking_sequence,
    "w04_delay_change": windows.delay_change,
    "w05_next_leg": windows.next_leg,
    # The same results with every group cut, as very large groups are.
    "w01_delay_rank_at_port_split": lambda t: windows.delay_rank_at_port(t, split_rows=SMALL_SPLIT),
    "w02_revenue_rank_in_country_split": lambda t: windows.revenue_rank_in_country(t, split_rows=SMALL_SPLIT),
    "w03_booking_sequence_split": lambda t: windows.booking_sequence(t, split_rows=SMALL_SPLIT),
    "w04_delay_change_split": lambda t: windows.delay_change(t, split_rows=SMALL_SPLIT),
    "a03_value_concentration_split": lambda t: trends.value_concentration(t, split_rows=SMALL_SPLIT),
    "w06_year_to_date": windows.year_to_date,
    "a01_port_congestion": trends.port_congestion,
    "a02_lane_punctuality": trends.lane_punctuality,
    "a03_value_concentration": trends.value_concentration,
    "a04_voyage_load": trends.voyage_load,
    "a05_monthly_revenue": trends.monthly_revenue,
    "a06_delay_by_vessel": trends.delay_by_vessel,
    "v01_row_counts": quality.row_counts,
    "v02_v18_reference_orphans": quality.reference_orphans,
    "v19_fleet_roster": quality.fleet_roster,
    "v20_route_map_summary": quality.route_map_summary,
    "v21_voyage_schedule": quality.voyage_schedule,
    "v22_commercial_chain": quality.commercial_chain,
    "v23_longest_chain": quality.longest_chain,
    "p01_marker_sizes": shaping.marker_sizes,
    "p02_delay_series": shaping.delay_series,
    "p03_punctuality_bands": shaping.punctuality_bands,
    "p04_voyage_status_series": shaping.voyage_status_series,
    "p05_top_customers": shaping.top_customers,
    "p06_lane_labels": shaping.lane_labels,
    "p07_status_chart": shaping.status_chart,
    "p08_event_pins": shaping.event_pins,
    "p09_kpi_tiles": shaping.kpi_tiles,
    "p10_insights": shaping.insights,
    "p11_filter_options": shaping.filter_options,
    "p11_filtered_list": lambda t: shaping.filtered_list(t, statuses=OPEN_STATUSES, bl_prefix=" bl "),
    "t01_load_typed": _load_typed,
    "t01_accepted_rows": lambda t: _faulty_events(t)[0],
    "t01_rejected_rows": lambda t: _faulty_events(t)[1].select("event_id", "shipment_id", "reasons"),
    "t02_load_once": _load_once,
    "t02_load_once_pruned": lambda t: _load_once(t, prune=True),
    "t03_resolve_keys": _resolve_keys,
    "t04_constraint_audit": quality.constraint_audit,
    "t04_constraint_audit_merged": _merged_audit,
    "t05_voyage_status": lambda t: quality.voyage_status_audit(t, fixtures.as_of()),
    # Stored statuses are of another moment than the one audited: most disagree.
    "t05_voyage_status_stale": lambda t: quality.voyage_status_audit(t, STALE_AS_OF),
    "t05_voyage_status_over_time": lambda t: quality.voyage_status_over_time(
        t, "timestamp_ntz'1995-01-01 09:30:00'", "interval 1 day", 2700
    ),
    "t06_event_chains": quality.event_chain_audit,
    "t07_check_digits": quality.check_digit_audit,
    # The same audits over tables with faults of every kind.
    "v02_v18_reference_orphans_damaged": lambda t: quality.reference_orphans(fixtures.damaged(t)),
    "v23_longest_chain_damaged": lambda t: quality.longest_chain(fixtures.damaged(t)),
    "t04_constraint_audit_damaged": lambda t: quality.constraint_audit(fixtures.damaged(t)),
    "t04_constraint_audit_merged_damaged": lambda t: _merged_audit(fixtures.damaged(t)),
    "t06_event_chains_damaged": lambda t: quality.event_chain_audit(fixtures.damaged(t)),
    "t09_guarded_query": _guarded,
    "t09_guard_cases": _guard_cases,
}

# Operators over tables of texts.
TEXTS: dict[str, Query] = {
    "t08_sql_audit": _audit_log,
    "t10_reply_extraction": lambda spark, sf_dir: dialogue.extract_reply(fixtures.replies(spark, sf_dir)).select(
        "conv_id", "turn", "sql", "explanation"
    ),
    "t11_recent_messages": lambda spark, sf_dir: dialogue.recent_messages(_conversations(spark, sf_dir)),
    "t11_cleared": lambda spark, sf_dir: dialogue.cleared(
        _conversations(spark, sf_dir), _conversations(spark, sf_dir).filter("role = 'system'").select("conv_id", "turn")
    ).select("conv_id", "turn", "role", "text"),
    "t12_question_quota": lambda spark, sf_dir: dialogue.question_quota(_conversations(spark, sf_dir)),
    "t11_recent_messages_long": lambda spark, sf_dir: dialogue.recent_messages(
        fixtures.long_conversations(spark, sf_dir)
    ),
    "t12_question_quota_long": lambda spark, sf_dir: dialogue.question_quota(
        fixtures.long_conversations(spark, sf_dir)
    ),
}


@lru_cache(maxsize=4)
def _tables(spark: SparkSession, sf_dir: str) -> FreightTables:
    """The freight views over a directory: their definitions are made once per session, their rows never kept."""
    return fixtures.freight(spark, sf_dir)


def _over_fixtures(operator: Callable[[FreightTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_tables(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {**{name: _over_fixtures(operator) for name, operator in FREIGHT.items()}, **TEXTS}
