"""Properties of the physical plans that matter at scale."""

import re

import pytest

from seaflow.operators import tracking
from seaflow.plans.registry import queries
from seaflow.sources.fixtures import freight
from seaflow.sources.tables import FreightTables

SF_DIR = "/root/testdata/sf0.001"
QUERIES = queries()

# Windows and joins without a key run over one row per status, month or top customer, over less rows than the split
# bound (a03, a06), or join frames of one row.
KEYLESS = {
    "a03_value_concentration",
    "a03_value_concentration_split",
    "a05_monthly_revenue",
    "a06_delay_by_vessel",
    "k11_shipment_status_breakdown",
    "k14_category_kpis",
    "k15_all_kpis",
    "p07_status_chart",
    "p09_kpi_tiles",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cartesian_no_single_task_windows(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan
    if name not in KEYLESS:
        assert "BroadcastNestedLoopJoin" not in plan
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if re.search(r"\bWindow \[", line):
                assert not any("Exchange SinglePartition" in below for below in lines[i + 1 : i + 4])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("freight"))
    t = freight(spark, SF_DIR)
    for name in ("shipment", "customer", "voyage", "route", "port", "voyage_stop"):
        t.table(name).write.parquet(f"{path}/{name}")
    return FreightTables.load(spark, path)


def test_look_up_is_pushed_to_the_files_and_shuffles_nothing(stored):
    plan = plan_of(tracking.shipment_detail(stored, "bl000000000007"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(bl_number,BL000000000007\)", plan)
    assert "Exchange hashpartitioning" not in plan


def test_scans_read_only_the_columns_needed(stored):
    from seaflow.operators.operations import on_time_performance

    plan = plan_of(on_time_performance(stored))
    assert "ReadSchema: struct<ata:timestamp_ntz,delay_hours:double>" in plan


def test_numbering_of_stops_is_pruned_when_unused(spark):
    from seaflow.operators.network import avg_delay_by_route

    assert "Window" not in plan_of(avg_delay_by_route(freight(spark, SF_DIR)))


@pytest.mark.parametrize("name, scans", [("t04_constraint_audit", 3), ("t04_constraint_audit_merged", 6), ("v02_v18_reference_orphans", 3)])
def test_audits_scan_a_table_once(spark, name, scans):
    """Three tables are views over the lines of orders; the merged audit reads them for each of two batches."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == scans
