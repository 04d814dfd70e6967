from seaflow.operators import increments, quality
from seaflow.sources.schema import TABLES
from seaflow.sources.tables import FreightTables
from small import at, dicts, tables


def batches(spark):
    """Orphans, repeated keys and disagreeing statuses of which some show only when the batches meet."""
    first = tables(
        spark,
        port=[{"port_id": 1, "un_locode": "AAAAA"}, {"port_id": 2, "un_locode": "BBBBB"}],
        voyage=[{"voyage_id": 1, "status": "Scheduled"}, {"voyage_id": 2, "status": "Arrived"}],
        route=[{"route_id": 1, "origin_port_id": 1, "dest_port_id": 9, "route_name": None}],
        shipment=[
            {"shipment_id": 1, "voyage_id": 1, "status": "Delivered", "bl_number": "A"},
            {"shipment_id": 2, "voyage_id": 1, "status": "Cancelled", "bl_number": "B"},
            {"shipment_id": 3, "voyage_id": 3, "status": "Loaded", "bl_number": None},
        ],
        shipment_event=[{"event_id": n, "shipment_id": 50 + n % 2, "event_type": "Odd"} for n in range(4)],
    )
    second = tables(
        spark,
        port=[{"port_id": 9, "un_locode": "AAAAA"}, {"port_id": 2, "un_locode": "CCCCC", "is_transshipment": 7}],
        voyage=[{"voyage_id": 3, "status": "Scheduled"}, {"voyage_id": 2, "status": "Arrived"}],
        shipment=[
            {"shipment_id": 4, "voyage_id": 2, "status": "Booked", "bl_number": "A"},
            {"shipment_id": 51, "voyage_id": 8, "status": "Booked", "bl_number": None},
        ],
        shipment_event=[{"event_id": 3, "shipment_id": 50, "event_type": "Delivered"}],
    )
    return first, second


def lines(report):
    found = dicts(report)
    by_rule = {(r["table_name"], r["rule"]): r["violations"] for r in found}
    assert len(by_rule) == len(found)
    return by_rule


def test_merged_equals_whole(spark):
    first, second = batches(spark)
    whole = FreightTables(spark, {n: first.table(n).unionByName(second.table(n)) for n in TABLES})
    merged = lines(
        increments.audit_of(increments.merged_counts(increments.audit_counts(first), increments.audit_counts(second)))
    )
    assert merged == lines(quality.constraint_audit(whole))
    assert merged["port", "unique: un_locode"] == 1 and merged["port", "unique: port_id"] == 1
    assert merged["route", "reference: dest_port_id"] == 0  # its port came with the second batch
    assert merged["shipment", "status agrees with voyage"] == 4  # two of them through a voyage that is there twice
    assert merged["shipment_event", "reference: shipment_id"] == 3
    assert merged["shipment_event", "unique: event_id"] == 1


def test_stored_counts_take_batches_in_any_order(spark, tmp_path):
    first, second = batches(spark)
    increments.audit_counts(first).write.partitionBy("kind").parquet(str(tmp_path / "counts"))
    stored = spark.read.parquet(str(tmp_path / "counts"))
    batch = increments.audit_counts(second)
    assert lines(increments.audit_of(increments.merged_counts(stored, batch))) == lines(
        increments.audit_of(increments.merged_counts(batch, stored))
    )
    scans = increments.audit_of(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "shipment_event" not in scans.replace("shipment_event|", "")  # only the counts are read


def test_a_batch_of_some_tables_and_an_empty_one(spark):
    first, _ = batches(spark)
    some = FreightTables(spark, {"port": first.table("port")})
    whole = increments.merged_counts(increments.audit_counts(some), increments.audit_counts(tables(spark)))
    report = lines(increments.audit_of(whole))
    assert set(report) == set(lines(quality.constraint_audit(tables(spark))))
    assert sum(report.values()) == 0


def test_a_parent_arrives_without_its_children(spark):
    first, second = batches(spark)
    parents = FreightTables(spark, {"shipment": second.table("shipment"), "voyage": second.table("voyage")})
    merged = increments.merged_counts(increments.audit_counts(parents), increments.audit_counts(first))
    report = lines(increments.audit_of(merged))
    assert report["shipment_event", "reference: shipment_id"] == 2  # 51 is there, 50 isn't
    assert report["voyage", "unique: voyage_id"] == 1
