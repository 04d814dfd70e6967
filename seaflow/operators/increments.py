"""The constraint audit over stored counts: an appended batch is counted and merged, older files are not read again.

``audit_counts`` folds tables into one row for each (kind, rule, value): of kind ``value`` the rules that a single row can
break (without a value), occurrences of unique keys, values of foreign keys and of the keys they refer to; of kinds
``voyage`` and ``shipment`` their numbers by voyage and status. Such rows add up, so ``merged_counts`` of a stored frame
and that of a batch equal the counts of all rows. ``audit_of`` turns them into the lines of
``quality.constraint_audit``: a key that repeats, or whose parent arrives, only across batches counts as it does over
whole tables.

A stored frame has a row for each distinct key. Store it partitioned by ``kind``: a batch then merges with what it needs.
Rules are stored by number (``quality.rule_number``). Counts are folded before the shuffle, so a value with a third of all
rows is one row in each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from seaflow.functions.measures import totals
from seaflow.operators.quality import (
    VALUE,
    _quoted,
    _reported,
    named_rules,
    reference_rules,
    row_rules,
    unique_rules,
    value_counts,
    violations,
)
from seaflow.sources.schema import SHIPMENT_STATUS_OF_VOYAGE, TABLES
from seaflow.sources.tables import FreightTables

COLUMNS = ("kind", *VALUE, "n", "parents")
STATUS_RULE = "shipment|status agrees with voyage"


def _statuses(t: FreightTables, name: str) -> DataFrame:
    """Rows by voyage and status; voyages and shipments meet when the counts are audited."""
    rows = t.table(name).filter("voyage_id is not null and status is not null")
    return totals(rows, ["voyage_id", "status"], "count(*) as n").selectExpr(
        f"'{name}' as kind", "0 as rule", "voyage_id as a", "cast(null as bigint) as b", "status as text", "n", "0L as parents"
    )


def audit_counts(t: FreightTables) -> DataFrame:
    """The counts over the rows of ``t``, whole tables or a batch of any of them."""
    values = value_counts(t).selectExpr("'value' as kind", *VALUE, "n", "parents")
    statuses = [_statuses(t, name) for name in ("voyage", "shipment") if name in t.names()]
    return reduce(DataFrame.unionByName, [values, *statuses])


def merged_counts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The counts of both together; merging is associative, and its order doesn't matter."""
    return totals(
        stored.select(*COLUMNS).unionByName(batch.select(*COLUMNS)),
        ["kind", *VALUE],
        "sum(n) as n",
        "sum(parents) as parents",
    )


def audit_of(counts: DataFrame) -> DataFrame:
    """Every declared constraint with the number of violations, as ``quality.constraint_audit`` reports them.

    The values are read once, for all rules together.
    """
    rules = [*row_rules(TABLES), *unique_rules(TABLES), *reference_rules()]
    single = violations(counts.filter("kind = 'value'"), rules)
    allowed = " or ".join(
        f"(voyage_status = '{voyage}' and status in ({_quoted(statuses)}))"
        for voyage, statuses in SHIPMENT_STATUS_OF_VOYAGE.items()
    )
    voyages = counts.filter("kind = 'voyage'").selectExpr("a", "text as voyage_status", "n as times")
    carried = counts.filter("kind = 'shipment'").selectExpr("a", "text as status", "n")
    broken = totals(
        carried.filter("status <> 'Cancelled'").join(voyages, "a"),
        [],
        f"sum(if({allowed}, 0, n * times)) as violations",
    ).selectExpr(f"'{STATUS_RULE}' as rule", "coalesce(violations, 0) as violations")
    return named_rules(_reported(single.unionByName(broken), "rule", [*rules, STATUS_RULE], "violations"))
