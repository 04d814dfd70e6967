"""Pages, stored look-ups, rejected rows and loads against large tables."""

import re

from small import at, dicts, frame

from seaflow.operators import loading, tracking
from seaflow.sources.fixtures import freight
from seaflow.sources.schema import TABLES
from seaflow.sources.tables import FreightTables, checked

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_one_after_another_are_the_list(spark):
    t = freight(spark, SF_DIR)
    whole, found, after = dicts(tracking.shipment_list(t)), [], None
    size = len(whole) // 3 + 1
    while page := dicts(tracking.shipment_page(t, size, after)):
        found += page
        after = (str(page[-1]["booking_date"]), page[-1]["bl_number"])
    assert found == whole
    plan = plan_of(tracking.shipment_page(t, size, after))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_pages_end_with_shipments_without_date(spark):
    rows = [{"bl_number": f"B{n}", "booking_date": at(n) if n < 3 else None} for n in range(1, 5)]
    one = {name: frame(spark, name, [{f"{name}_id": 0}]) for name in ("customer", "voyage", "route", "port")}
    t = FreightTables(spark, one | {"shipment": frame(spark, "shipment", rows)})
    numbers, after = [], None
    while page := dicts(tracking.shipment_page(t, 1, after)):
        numbers.append(page[0]["bl_number"])
        date = page[0]["booking_date"]
        after = (date and str(date), page[0]["bl_number"])
    assert numbers == ["B2", "B1", "B3", "B4"]


def test_bloom_filters_pass_over_row_groups(spark, tmp_path):
    """A key that the range of every file holds but no file: nothing is read of the ordered table."""
    shipments = spark.range(0, 40_000, 2).selectExpr("id as shipment_id", "'BL' || lpad(id * 7919 % 40000, 9, '0') as bl_number")
    rows = frame(spark, "shipment", [{}]).drop("shipment_id", "bl_number").crossJoin(shipments)
    t = FreightTables(spark, {"shipment": rows.select(*TABLES["shipment"].columns)})
    scanned = {}
    for ordered in (False, True):
        path = str(tmp_path / str(ordered))
        t.save(path, ordered=ordered)
        hit = spark.read.parquet(f"{path}/shipment").filter("shipment_id = 20001")
        assert hit.collect() == []
        leaves = hit._jdf.queryExecution().executedPlan().collectLeaves()
        scanned[ordered] = leaves.head().metrics().apply("numOutputRows").value()
    assert scanned[True] == 0 < scanned[False]


def test_one_bad_cell_is_reported_and_the_rest_loads(spark):
    raw = spark.createDataFrame(
        [("1", "7", "Gate In", "2025-01-01 00:00:00", None), ("x", "7", None, "soon", "2"), ("3", "99999999999999999999", "Gate In", "2025-01-02", "3")],
        "event_id string, shipment_id string, event_type string, event_timestamp string, port_id string",
    )
    accepted, rejected = checked(raw, TABLES["shipment_event"])
    assert accepted.schema == TABLES["shipment_event"].schema or accepted.columns == TABLES["shipment_event"].columns
    assert [(r["event_id"], r["created_by"]) for r in dicts(accepted)] == [(1, "SYSTEM")]
    assert {r["event_id"]: r["reasons"] for r in dicts(rejected)} == {
        "x": "event_id: not a bigint; event_type: missing; event_timestamp: not a timestamp_ntz",
        "3": "shipment_id: not a bigint",
    }


def test_pruned_load_equals_the_plain_one_and_filters_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(loading, "FILTER_BITS", 1 << 17)  # some false hits
    existing = spark.range(0, 60_000, 3).selectExpr("'k' || id as k", "id % 5 as part", "id as v")
    incoming = spark.range(0, 5_000).selectExpr("if(id % 50 = 1, null, 'k' || id) as k", "id % 5 as part", "-id as v")
    incoming = incoming.unionByName(incoming)
    plain = loading.load_once(incoming, existing, ["k", "part"], ["v"])
    pruned = loading.load_once(incoming, existing, ["k", "part"], ["v"], prune=True)
    assert sorted(map(str, pruned.collect())) == sorted(map(str, plain.collect()))
    there = loading.possible_matches(existing, incoming.filter("k is not null"), ["k", "part"])
    matches = existing.join(incoming, ["k", "part"], "left_semi").count()
    assert matches <= there.count() <= matches + 20_000 * 0.06
    plan = plan_of(loading.new_rows(incoming, existing, ["k", "part"], ["v"], prune=True))
    tested = re.search(r"BroadcastHashJoin \[_block#[^\n]*shiftright[^\n]*\n(.*)", plan, re.DOTALL)
    assert tested and "hashpartitioning(k#" not in tested[1].split("BroadcastExchange")[0]
