"""Results that must not depend on the order of rows, and rows that must not get lost."""

import random

import small

from seaflow.functions.measures import exact_total, totals
from seaflow.operators import dialogue, loading, operations, quality, trends
from seaflow.sources.tables import FreightTables


def _stops(spark, n=400, voyages=12):
    rng = random.Random(4)
    rows = [
        {"voyage_id": i % voyages, "port_id": 1, "ata": small.at(2), "stop_sequence": i, "delay_hours": rng.randint(0, 999) / 100}
        for i in range(n)
    ]
    voyage = [{"voyage_id": v, "vessel_id": v % 3 + 1, "route_id": 1, "voyage_number": f"v{v}"} for v in range(voyages)]
    vessel = [{"vessel_id": v, "vessel_name": f"n{v}"} for v in (1, 2, 3)]
    return small.tables(spark, voyage_stop=rows, voyage=voyage, vessel=vessel, route=[{"route_id": 1}], port=[{"port_id": 1}])


def test_delays_do_not_depend_on_partitions(spark):
    t = _stops(spark)
    for operator in (
        operations.on_time_performance,
        operations.delayed_voyages,
        operations.avg_delay_by_port,
        trends.port_congestion,
        trends.delay_by_vessel,
    ):
        results = []
        for n in (1, 7, 64):
            frames = {name: t.table(name) for name in t.names()}
            frames["voyage_stop"] = t.voyage_stop.repartition(n)
            results.append([tuple(r) for r in operator(FreightTables(spark, frames)).collect()])
        assert results[0] == results[1] == results[2] != []


def test_amounts_are_summed_before_they_are_rounded(spark):
    df = spark.createDataFrame([(1.004,), (1.004,), (1.004,)], "x double")
    assert totals(df, [], f"{exact_total('x')} as x").first().x == 3.012


def test_rows_with_null_keys_are_all_new(spark):
    schema = "bl_number string, shipment_id long, status string"
    incoming = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("x", 3, "c"), ("x", 4, "d")], schema)
    existing = spark.createDataFrame([("y", 9, "e")], schema)
    loaded = loading.load_once(incoming, existing, ["bl_number"], ["shipment_id"])
    assert sorted(r.shipment_id for r in loaded.collect()) == [1, 2, 3, 9]


def test_all_roles_are_messages(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "model", "m")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert dialogue.recent_messages(df).count() == 3
    assert dialogue.recent_messages(df, turns=1).count() == 2
    assert dialogue.recent_messages(df, roles=("user",)).count() == 1


def test_duplicate_keys_are_counted_on_every_column(spark):
    t = small.tables(
        spark,
        voyage_stop=[
            {"stop_id": 1, "voyage_id": 1, "stop_sequence": 1},
            {"stop_id": 2, "voyage_id": 1, "stop_sequence": 2},
            {"stop_id": 3, "voyage_id": 1, "stop_sequence": 2},
        ],
    )
    found = {(r.table_name, r.rule): r.violations for r in quality.constraint_audit(t).collect()}
    assert found[("voyage_stop", "unique: stop_id")] == 0
    assert found[("voyage_stop", "unique: voyage_id, stop_sequence")] == 1
