"""Tables, loading, SQL access and the shape of the KPI library."""

import pytest
from pyspark.sql import DataFrame
from small import at, dicts, frame, tables

from seaflow.functions.measures import totals
from seaflow.operators import catalog, loading, quality
from seaflow.sources.fixtures import freight
from seaflow.sources.schema import TABLES
from seaflow.sources.tables import FreightTables, conform

SF_DIR = "/root/testdata/sf0.001"

COLUMNS = {
    "vessel_utilization": "vessel_name operator teu_capacity year_built total_voyages completed active scheduled arrived",
    "capacity_vs_booked_teu": "vessel_name operator teu_capacity voyage_number status container_count booked_teu "
    "utilization_pct",
    "busiest_ports": "port_name un_locode country_code is_transshipment total_calls distinct_voyages "
    "outbound_shipments inbound_shipments avg_delay_h",
    "avg_delay_by_route": "route_name service_name scheduled_transit_days voyage_count total_stops avg_delay_h "
    "max_delay_h stops_over_24h otp_pct",
    "leg_distances": "route_name service_name leg_sequence from_port from_locode from_country to_port to_locode "
    "to_country distance_nm typical_days avg_speed_nm_per_day",
    "on_time_performance": "total_stops completed_stops pending_stops on_time delayed severely_delayed otp_pct "
    "avg_delay_h max_delay_h",
    "delayed_voyages": "voyage_number status vessel_name operator route_name departure_date arrival_date stop_count "
    "total_delay_h avg_delay_h max_stop_delay_h stops_over_24h",
    "avg_delay_by_port": "port_name un_locode country_code latitude longitude is_transshipment total_calls "
    "arrived_calls avg_delay_h max_delay_h delayed_arrivals severe_delays otp_pct",
    "top_customers_by_value": "company_name country_code industry shipment_count total_value_usd "
    "avg_shipment_value_usd total_weight_kg voyages_used status_variety",
    "revenue_by_trade_lane": "route_name service_name origin_port dest_port shipment_count customer_count "
    "total_value_usd avg_value_usd total_weight_kg avg_weight_kg",
    "shipment_status_breakdown": "status shipment_count pct_of_total total_value_usd avg_value_usd total_weight_kg "
    "avg_weight_kg",
    "reefer_by_type": "container_type total_containers reefer_count dry_count reefer_pct avg_temp_c min_temp_c max_temp_c",
    "reefer_summary": "total_containers reefer_containers dry_containers reefer_pct avg_reefer_temp_c min_temp_c "
    "max_temp_c",
}


@pytest.fixture(scope="module")
def sample(spark):
    return freight(spark, SF_DIR)


@pytest.fixture(scope="module")
def kpis(sample):
    return catalog.get_all_kpis(sample)


def test_eleven_tables_with_their_schema(sample):
    assert sample.names() == list(TABLES) and len(TABLES) == 11
    for name, spec in TABLES.items():
        found = [(f.name, f.dataType) for f in sample.table(name).schema.fields]
        assert found == [(f.name, f.dataType) for f in spec.schema.fields]


def test_constraint_vocabulary():
    assert sum(len(spec.unique) for spec in TABLES.values()) == 7
    assert sum(len(spec.references) for spec in TABLES.values()) == 17


def test_every_table_has_rows_and_no_orphans(sample):
    assert all(row["row_count"] > 0 for row in dicts(quality.row_counts(sample)))
    report = dicts(quality.reference_orphans(sample))
    assert len(report) == 17 and all(row["orphans"] == 0 for row in report)


def test_categories(sample, kpis):
    assert set(catalog.fleet(sample)) == {"vessel_utilization", "capacity_vs_booked_teu"}
    assert set(catalog.network(sample)) == {"busiest_ports", "avg_delay_by_route", "leg_distances"}
    assert set(catalog.operations(sample)) == {"on_time_performance", "delayed_voyages", "avg_delay_by_port"}
    assert len(catalog.commercial(sample)) == 5
    assert set(kpis) == set(COLUMNS)
    assert all(isinstance(df, DataFrame) for df in kpis.values())


@pytest.mark.parametrize("name", COLUMNS)
def test_kpi_columns_and_rows(kpis, name):
    df = kpis[name]
    assert sorted(df.columns) == sorted(COLUMNS[name].split())
    assert df.limit(1).count() == 1


@pytest.mark.parametrize("name, column", [("busiest_ports", "total_calls"), ("top_customers_by_value", "total_value_usd")])
def test_kpi_order(kpis, name, column):
    values = [row[column] for row in dicts(kpis[name])]
    assert values == sorted(values, reverse=True)


def test_run_query(sample):
    df = sample.run_query("SELECT vessel_id, vessel_name FROM VESSEL")
    assert df.columns == ["vessel_id", "vessel_name"] and df.count() == 10
    kinds = sample.run_query("SELECT * FROM VESSEL WHERE vessel_type = ?", ("Container",))
    assert {row["vessel_type"] for row in dicts(kinds)} == {"Container"}
    assert sample.run_query("SELECT * FROM VESSEL WHERE 1 = 0").count() == 0


def test_run_query_leaves_the_callers_catalog_alone(spark, sample):
    sample.run_query("SELECT 1 FROM PORT")
    assert not spark.catalog.tableExists("vessel")


def test_date_functions_of_the_model_dialect(spark):
    t = tables(spark, voyage=[{"departure_date": at(1, 6), "arrival_date": at(9, 5)}])
    row = t.run_query(
        "SELECT strftime('%Y-%m', departure_date) AS m, julianday(departure_date) AS j, "
        "CAST(julianday(arrival_date) - julianday(departure_date) AS INTEGER) AS d FROM VOYAGE"
    ).first()
    assert (row.m, row.j, row.d) == ("2025-01", 2460676.75, 7)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_save_and_load(spark, tmp_path, fmt):
    t = tables(
        spark,
        voyage_stop=[{"stop_sequence": 1, "eta": at(2), "ata": None, "delay_hours": 1.25}, {"ata": at(3)}],
        port=[{"port_name": "A, \"B\""}],
    )
    t.save(str(tmp_path / fmt), fmt)
    back = FreightTables.load(spark, str(tmp_path / fmt), fmt)
    for name in ("voyage_stop", "port"):
        assert sorted(map(str, back.table(name).collect())) == sorted(map(str, t.table(name).collect()))
        assert back.table(name).columns == TABLES[name].columns


def test_ordered_files_do_not_overlap(spark, sample, tmp_path):
    shipments = FreightTables(spark, {"shipment": sample.shipment.repartition(8)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shipments.save(str(tmp_path), ordered=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = FreightTables.load(spark, str(tmp_path)).shipment
    files = totals(
        stored.selectExpr("_metadata.file_path as file", "bl_number"),
        ["file"],
        "min(bl_number) as first",
        "max(bl_number) as last",
    )
    spans = sorted((row["first"], row["last"]) for row in dicts(files))
    assert len(spans) > 1 and stored.count() == sample.shipment.count()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_unknown_format_and_table(spark):
    with pytest.raises(ValueError):
        FreightTables.load(spark, "/nowhere", "xlsx")
    with pytest.raises(ValueError):
        FreightTables(spark, {"ghost": spark.range(1)})


def test_conform_fills_defaults(spark):
    raw = spark.createDataFrame([("7", "AB123", "A", "AB", "1.5", "2", "UTC")]).toDF(
        "port_id", "un_locode", "port_name", "country_code", "latitude", "longitude", "timezone"
    )
    row = conform(raw, TABLES["port"]).first()
    assert (row.port_id, row.latitude, row.is_transshipment) == (7, 1.5, 0)
    with pytest.raises(ValueError):
        conform(raw.drop("un_locode"), TABLES["port"])


def test_load_once_is_idempotent(spark):
    incoming = frame(spark, "port", [{"un_locode": "A", "port_name": "new"}, {"un_locode": "B"}, {"un_locode": "B"}])
    existing = frame(spark, "port", [{"port_id": 9, "un_locode": "A", "port_name": "old"}])
    once = loading.load_once(incoming, existing, ["un_locode"], ["port_id"])
    assert sorted((r.un_locode, r.port_name, r.port_id) for r in once.collect()) == [("A", "old", 9), ("B", "x", 2)]
    twice = loading.load_once(incoming, once, ["un_locode"], ["port_id"])
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_resolve_keys(spark):
    facts = spark.createDataFrame([(1, "A"), (2, "?")], "id long, code string")
    ports = frame(spark, "port", [{"port_id": 5, "un_locode": "A"}])
    resolved = loading.resolve_keys(facts, ports, "un_locode", "port_id", column="code")
    assert sorted(tuple(r) for r in resolved.collect()) == [(1, 5), (2, None)]
