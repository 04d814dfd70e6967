"""Business rules on hand-made tables."""

import pytest
from small import at, dicts, frame, tables

from seaflow.functions import measures
from seaflow.operators import commercial, fleet, joins, network, operations, quality, shaping, tracking, trends


def stop(voyage, seq, delay, port=1, arrived=True):
    return {
        "voyage_id": voyage,
        "stop_sequence": seq,
        "port_id": port,
        "delay_hours": float(delay),
        "ata": at(2) if arrived else None,
    }


@pytest.fixture(scope="module")
def world(spark):
    """Two ports called at and one not; two vessels, one idle; voyages with and without shipments."""
    return tables(
        spark,
        port=[
            {"port_id": 1, "port_name": "Alpha", "un_locode": "AAAAA", "country_code": "AA", "is_transshipment": 1},
            {"port_id": 2, "port_name": "Beta", "un_locode": "BBBBB", "country_code": "BB"},
            {"port_id": 3, "port_name": "Gamma", "un_locode": "CCCCC", "country_code": "CC"},
        ],
        vessel=[
            {"vessel_id": 1, "vessel_name": "One", "gross_tonnage": 1000, "teu_capacity": 10},
            {"vessel_id": 2, "vessel_name": "Two", "gross_tonnage": 1000, "teu_capacity": None},
            {"vessel_id": 3, "vessel_name": "Idle", "gross_tonnage": 1000, "teu_capacity": 5},
        ],
        route=[
            {"route_id": 1, "route_name": "East", "origin_port_id": 1, "dest_port_id": 2},
            {"route_id": 2, "route_name": "Bare", "origin_port_id": 2, "dest_port_id": 1},
        ],
        route_leg=[
            {"route_id": 1, "leg_sequence": 1, "from_port_id": 1, "to_port_id": 3, "distance_nm": 100, "typical_days": 3},
            {"route_id": 1, "leg_sequence": 2, "from_port_id": 3, "to_port_id": 2, "distance_nm": 50, "typical_days": 0},
        ],
        voyage=[
            {"voyage_id": 1, "voyage_number": "V1", "vessel_id": 1, "route_id": 1, "status": "Completed"},
            {"voyage_id": 2, "voyage_number": "V2", "vessel_id": 2, "route_id": 1, "status": "Departed"},
            {"voyage_id": 3, "voyage_number": "V3", "vessel_id": 1, "route_id": 1, "status": "In Transit"},
        ],
        voyage_stop=[
            stop(1, 1, 0),
            stop(1, 2, 4),
            stop(1, 3, 30, port=2),
            stop(2, 1, 5),
            stop(2, 2, 40, port=2, arrived=False),
            stop(3, 1, 0, port=2),
        ],
        customer=[{"customer_id": 1, "company_name": "Acme"}],
        shipment=[
            {
                "shipment_id": 1,
                "bl_number": "BL1",
                "customer_id": 1,
                "voyage_id": 1,
                "origin_port_id": 1,
                "dest_port_id": 2,
                "status": "Delivered",
                "total_weight_kg": 950.0,
                "total_value_usd": 100.0,
            },
            {
                "shipment_id": 2,
                "bl_number": "BL2",
                "customer_id": 1,
                "voyage_id": 2,
                "origin_port_id": 1,
                "dest_port_id": 2,
                "status": "In Transit",
                "total_weight_kg": 600.0,
                "total_value_usd": 300.0,
            },
        ],
        container=[
            {"container_id": 1, "shipment_id": 1, "container_type": "20GP"},
            {"container_id": 2, "shipment_id": 1, "container_type": "40RF", "is_reefer": 1, "temperature_c": -5.0},
            {"container_id": 3, "shipment_id": 1, "container_type": "odd"},
        ],
        cargo_item=[{"container_id": 1, "value_usd": 10.5}, {"container_id": 1, "value_usd": 20.0}],
        shipment_event=[
            {"event_id": 1, "shipment_id": 1, "event_type": "Gate In", "event_timestamp": at(3), "port_id": 1},
            {"event_id": 2, "shipment_id": 1, "event_type": "Booking Confirmed", "event_timestamp": at(1)},
        ],
    )


def by(rows, column):
    return {row[column]: row for row in rows}


def test_on_time_needs_arrival_and_delayed_includes_severe(world):
    row = dicts(operations.on_time_performance(world))[0]
    assert (row["total_stops"], row["completed_stops"], row["pending_stops"]) == (6, 5, 1)
    assert (row["on_time"], row["delayed"], row["severely_delayed"]) == (3, 2, 1)
    assert row["otp_pct"] == 60.0
    assert row["avg_delay_h"] == 7.8  # arrived stops only
    assert row["max_delay_h"] == 40.0  # all stops


def test_bands_take_severe_out_of_delayed(world):
    bands = by(dicts(shaping.punctuality_bands(world)), "band")
    assert [b["stops"] for b in bands.values()] == [3, 1, 1, 1]


def test_route_average_covers_open_stops(world):
    row = dicts(network.avg_delay_by_route(world))[0]
    assert row["avg_delay_h"] == 13.17  # 79 / 6
    assert (row["voyage_count"], row["total_stops"], row["stops_over_24h"]) == (3, 6, 2)


def test_empty_voyage_counts_one_teu_and_unknown_capacity_sorts_last(world):
    rows = dicts(fleet.capacity_vs_booked_teu(world))
    teu = {r["voyage_number"]: (r["container_count"], r["booked_teu"], r["utilization_pct"]) for r in rows}
    assert teu == {"V1": (3, 4, 40.0), "V2": (0, 1, None), "V3": (0, 1, 10.0)}
    assert [r["voyage_number"] for r in rows] == ["V1", "V3", "V2"]


def test_active_means_under_way_and_idle_vessels_stay(world):
    rows = by(dicts(fleet.vessel_utilization(world)), "vessel_name")
    assert rows["One"]["active"] == 1 and rows["Two"]["active"] == 1
    assert rows["Idle"]["total_voyages"] == 0 and rows["Idle"]["completed"] == 0


def test_port_without_calls(world):
    row = by(dicts(network.busiest_ports(world)), "port_name")["Gamma"]
    assert (row["total_calls"], row["distinct_voyages"], row["avg_delay_h"]) == (0, 0, None)
    assert by(dicts(network.busiest_ports(world)), "port_name")["Alpha"]["outbound_shipments"] == 2


def test_zero_days_give_no_speed(world):
    speeds = [r["avg_speed_nm_per_day"] for r in dicts(network.leg_distances(world))]
    assert speeds == [33.0, None]


def test_lane_punctuality_looks_at_last_stop_of_arrived_shipments(world):
    rows = dicts(trends.lane_punctuality(world))
    assert rows == [
        {
            "trade_lane": "AA -> BB",
            "shipments_measured": 1,
            "on_time": 0,
            "otp_pct": 0.0,
            "avg_final_delay_hours": 30.0,
        }
    ]


def test_load_bands(world):
    bands = {r["voyage_number"]: r["load_band"] for r in dicts(trends.voyage_load(world))}
    assert bands == {"V1": "Full", "V2": "Moderate", "V3": "Empty"}


def test_route_without_legs_has_no_distance(world):
    row = by(dicts(joins.route_leg_audit(world)), "route_name")["Bare"]
    assert (row["leg_count"], row["total_distance_nm"]) == (0, None)


def test_consecutive_legs(world):
    rows = dicts(joins.consecutive_legs(world))
    assert len(rows) == 1 and rows[0]["combined_nm"] == 150 and rows[0]["junction_port"] == "Gamma"


def test_above_route_average_is_strict(world):
    assert [r["bl_number"] for r in dicts(joins.above_route_average(world))] == ["BL2"]


def test_reefers(world):
    row = dicts(commercial.reefer_summary(world))[0]
    assert (row["total_containers"], row["reefer_containers"], row["dry_containers"]) == (3, 1, 2)
    assert (row["reefer_pct"], row["avg_reefer_temp_c"]) == (33.3, -5.0)


def test_summaries_over_nothing(spark):
    empty = tables(spark)
    stops = dicts(operations.on_time_performance(empty))[0]
    assert stops["total_stops"] == 0 and stops["on_time"] is None and stops["otp_pct"] is None
    assert dicts(commercial.reefer_summary(empty))[0]["reefer_pct"] is None
    assert dicts(shaping.kpi_tiles(empty))[0]["top_lane"] == "N/A"
    assert dicts(shaping.insights(empty)) == []


def test_look_up_by_one_number_and_by_frame(spark, world):
    assert [r["bl_number"] for r in dicts(tracking.shipment_detail(world, " bl1 "))] == ["BL1"]
    wanted = spark.createDataFrame([("BL2",), ("BL9",)], "bl_number string")
    assert [r["bl_number"] for r in dicts(tracking.shipment_meta(world, wanted))] == ["BL2"]
    assert dicts(tracking.shipment_detail(world, "BL9")) == []
    events = [r["event_type"] for r in dicts(tracking.event_timeline(world, "BL1"))]
    assert events == ["Booking Confirmed", "Gate In"]
    boxes = [(r["cargo_items"], r["cargo_value_usd"]) for r in dicts(tracking.shipment_containers(world, "BL1"))]
    assert sorted(boxes, key=str) == sorted([(2, 31.0), (0, None), (0, None)], key=str)
    stops = [(r["stop_sequence"], r["delay_hours"]) for r in dicts(tracking.shipment_stops(world, "BL1"))]
    assert stops == [(1, 0.0), (2, 4.0), (3, 30.0)]


def test_orphans_duplicates_and_domains(spark):
    t = tables(
        spark,
        port=[{"port_id": 1, "un_locode": "A"}, {"port_id": 2, "un_locode": "A", "is_transshipment": 7}],
        shipment_event=[
            {"shipment_id": 99, "port_id": None},
            {"shipment_id": 99, "port_id": 5, "event_type": "Gate In"},
            {"shipment_id": 99, "port_id": 1, "event_type": "Gate In"},
        ],
        route=[{"route_id": 1, "origin_port_id": 1, "dest_port_id": 3, "route_name": None}],
        route_leg=[{"route_id": 1, "leg_sequence": n} for n in (1, 1, 1, 2, 2, None, None)],
    )
    orphans = {r["fk"]: r["orphans"] for r in dicts(quality.reference_orphans(t))}
    assert orphans["SHIPMENT_EVENT.shipment_id"] == 3
    assert orphans["SHIPMENT_EVENT.port_id"] == 1
    assert orphans["ROUTE.dest_port_id"] == 1 and orphans["ROUTE.origin_port_id"] == 0
    report = {(r["table_name"], r["rule"]): r["violations"] for r in dicts(quality.constraint_audit(t))}
    assert report["port", "unique: un_locode"] == 1
    assert report["port", "domain: is_transshipment"] == 1
    assert report["shipment_event", "domain: event_type"] == 1
    assert report["route", "not null: route_name"] == 1
    assert report["route", "reference: dest_port_id"] == 1
    assert report["port", "unique: port_id"] == 0
    assert report["route_leg", "unique: route_id, leg_sequence"] == 2


def test_reports_are_complete_without_rows(spark):
    empty = tables(spark)
    assert len(dicts(quality.reference_orphans(empty))) == 17
    report = dicts(quality.constraint_audit(empty))
    assert all(row["violations"] == 0 for row in report)
    assert sum(row["rule"].startswith("unique") for row in report) == 18


@pytest.mark.parametrize(
    "hours, status",
    [(-1, "Scheduled"), (0, "Departed"), (6, "In Transit"), (239, "In Transit"), (240, "Arrived"), (312, "Completed")],
)
def test_status_of_a_voyage_over_time(spark, hours, status):
    t = tables(spark, voyage=[{"departure_date": at(1), "arrival_date": at(11), "status": status}])
    when = f"cast('{at(1, hours)}' as timestamp_ntz)"
    row = dicts(quality.voyage_status_audit(t, when))[0]
    assert (row["expected_status"], row["agrees"]) == (status, 1)


def chain(shipment, *types):
    return [
        {"event_id": 100 * shipment + i, "shipment_id": shipment, "event_type": e, "event_timestamp": at(i + 1)}
        for i, e in enumerate(types)
    ]


def test_event_chains(spark):
    t = tables(
        spark,
        shipment=[
            {"shipment_id": i, "bl_number": f"BL{i}", "status": s}
            for i, s in enumerate(["Loaded", "Loaded", "Loaded", "Booked", "Cancelled"], 1)
        ],
        shipment_event=chain(1, "Booking Confirmed", "Documents Received", "Gate In", "Customs Hold", "Loaded on Vessel")
        + chain(2, "Booking Confirmed", "Gate In", "Documents Received", "Loaded on Vessel")
        + chain(3, "Booking Confirmed", "Gate In", "Loaded on Vessel", "Exception")
        + chain(5, "Booking Confirmed", "Booking Confirmed", "Cancelled"),
    )
    rows = by(dicts(quality.event_chain_audit(t)), "bl_number")
    assert rows["BL1"]["conforms"] == 1
    assert (rows["BL2"]["in_order"], rows["BL2"]["conforms"]) == (0, 0)
    assert (rows["BL3"]["missing"], rows["BL3"]["extra"]) == ("Documents Received", "Exception")
    assert (rows["BL4"]["missing"], rows["BL4"]["event_count"]) == ("Booking Confirmed", 0)
    assert (rows["BL5"]["conforms"], rows["BL5"]["event_count"]) == (1, 3)


def test_check_digit(spark):
    body = "MSCU001000"
    digit = sum(ord(c) * (i + 1) for i, c in enumerate(body)) % 10
    t = tables(
        spark,
        container=[{"container_number": f"{body}{digit}"}, {"container_number": f"{body}{(digit + 1) % 10}"}],
    )
    assert [r["valid"] for r in dicts(quality.check_digit_audit(t))] == [1, 0]


@pytest.mark.parametrize(
    "value, digits, expected", [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.125, 2, 0.13), (None, 1, None)]
)
def test_rounding(spark, value, digits, expected):
    df = spark.createDataFrame([(value,)], "x double").selectExpr(measures.half_up("x", digits) + " as y")
    assert df.first().y == expected


def test_early_arrival_keeps_zero_delay(spark):
    """A stop may be reached before its ETA with a stored delay of zero: it is on time."""
    t = tables(spark, voyage_stop=[{"eta": at(5), "ata": at(4), "delay_hours": 0.0}])
    assert dicts(operations.on_time_performance(t))[0]["on_time"] == 1


def test_frame_helper_rejects_unknown_columns(spark):
    with pytest.raises(AssertionError):
        frame(spark, "port", [{"nope": 1}])


def test_voyage_status_over_time_is_the_audit_at_each_moment(spark):
    spans = [(3, 9), (3, 3), (5, 2), (None, 6), (4, None), (None, None), (-30, -20), (90, 95), (6, 6.1), (6, 6.1)]
    voyages = [
        {"departure_date": None if a is None else at(1, int(24 * a)), "arrival_date": None if b is None else at(1, int(24 * b))}
        for a, b in spans
    ]
    t = tables(spark, voyage=voyages)
    start, step, times = "timestamp_ntz'2025-01-02 00:00:00'", "interval 27 hours", 10
    found = {
        (r["seen_at"], r["status"]): r["voyages"] for r in dicts(quality.voyage_status_over_time(t, start, step, times))
    }
    assert len(found) == 50
    for n in range(times):
        moment = at(2, 27 * n)
        audit = dicts(quality.voyage_status_audit(t, f"timestamp_ntz'{moment}'").groupBy("expected_status").count())
        seen = {r["expected_status"]: r["count"] for r in audit}
        assert {s: found[moment, s] for s in quality.VOYAGE_STATUSES} == {s: seen.get(s, 0) for s in quality.VOYAGE_STATUSES}
