"""Row counts, reference and constraint audits, and checks of statuses, event chains and container numbers."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaflow.functions.measures import check_digit, exact_mean, exact_sum, half_up, tally, totals, voyage_status
from seaflow.operators.joins import leg_totals
from seaflow.operators.network import port_role
from seaflow.sources.schema import EVENT_CHAINS, OPTIONAL_EVENTS, SHIPMENT_STATUS_OF_VOYAGE, TABLES
from seaflow.sources.tables import FreightTables

TOP_ROWS = 20


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def row_counts(t: FreightTables) -> DataFrame:
    """Rows per table."""
    return _union(
        [
            totals(t.table(name), [], "count(*) as row_count").selectExpr(
                f"'{name.upper()}' as table_name", "row_count"
            )
            for name in t.names()
        ]
    )


# -- references --------------------------------------------------------------


def _reported(found: DataFrame, name: str, names: list[str], count: str) -> DataFrame:
    """Sum ``count`` per ``name``, with a line of zero for names that nothing was found for."""
    zeros = found.sparkSession.range(1).selectExpr(f"explode(array({_quoted(names)})) as {name}", f"0L as {count}")
    return totals(found.unionByName(zeros), [name], f"sum({count}) as {count}")


# Rules over values are audited by counts per (rule, value). A value is held as whole numbers where it is one and a rule as
# a number, since a count's row should take little memory: every key of every table has one.
VALUE = ("rule", "a", "b", "text")
COUNTS = ("sum(if(of_parent, 0L, n)) as n", "sum(if(of_parent, n, 0L)) as parents")


def rule_number(rule: str) -> int:
    """A number that stays the same as long as the rule's name does."""
    return zlib.crc32(rule.encode()) & 0x7FFFFFFF


def row_rules(names) -> dict[str, tuple[str, str]]:
    """Table and what breaks the rule, by rule: NOT NULL columns and closed domains."""
    rules = {}
    for name in names:
        spec = TABLES[name]
        rules |= {f"{name}|not null: {c}": (name, f"{c} is null") for c in spec.required}
        rules |= {f"{name}|domain: {c}": (name, f"{c} not in ({_quoted(domain)})") for c, domain in spec.domains.items()}
    return rules


def unique_rules(names) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Table and columns by rule; a key with a NULL part is never a duplicate."""
    return {
        f"{name}|unique: {', '.join(columns)}": (name, columns)
        for name in names
        for columns in ((TABLES[name].key,), *TABLES[name].unique)
    }


def reference_rules() -> dict[str, tuple[str, str, str]]:
    """Table, column and parent table by rule, over all tables; NULL refers to nothing."""
    return {
        f"{spec.name}|reference: {column}": (spec.name, column, parent)
        for spec in TABLES.values()
        for column, parent in spec.references.items()
    }


def _line(name: str, rule: str, columns: tuple[str, ...], of_parent: bool = False) -> str:
    """One value of a rule; NULL if a column is."""
    kinds = {f.name: f.dataType.simpleString() for f in TABLES[name].schema.fields}
    numbers = [c for c in columns if kinds[c] in ("bigint", "int")]
    texts = [c for c in columns if c not in numbers]
    if len(numbers) > 2 or len(texts) > 1:
        numbers, texts = [], [f"to_json(array({', '.join(f'cast({c} as string)' for c in columns)}))"]
    a, b = [f"cast({c} as bigint)" for c in (*numbers, "null", "null")][:2]
    present = " and ".join(f"{c} is not null" for c in columns)
    return f"if({present}, {_struct(rule, a, b, f'cast({(*texts, "null")[0]} as string)', of_parent)}, null)"


def _struct(rule: str, a: str, b: str, text: str, of_parent: bool) -> str:
    return (
        f"named_struct('rule', {rule_number(rule)}, 'a', {a}, 'b', {b}, 'text', {text}, 'of_parent', {str(of_parent).lower()})"
    )


def keys_counted_by() -> dict[str, str]:
    """A reference whose counts also hold the occurrences of its parent's key, by the rule that this key is unique."""
    found: dict[str, str] = {}
    for rule, (_, _, parent) in reference_rules().items():
        found.setdefault(f"{parent}|unique: {TABLES[parent].key}", rule)
    return found


def _lines(t: FreightTables, name: str, single: bool = True) -> DataFrame:
    """What the rules look at in a table, from one scan: its references and keys that are referred to, and, for rules over the
    table alone (``single``), its other unique keys and a line for a row that breaks rules, with their numbers as text."""
    lines = [_line(name, rule, (column,)) for rule, (child, column, _) in reference_rules().items() if child == name]
    for rule, (_, _, parent) in reference_rules().items():
        if parent == name:
            lines.append(_line(name, rule, (TABLES[name].key,), of_parent=True))
    if single:
        others = {rule: columns for rule, (_, columns) in unique_rules([name]).items() if rule not in keys_counted_by()}
        lines += [_line(name, rule, columns) for rule, columns in others.items()]
        broken = {rule: f"coalesce({b}, false)" for rule, (_, b) in row_rules([name]).items()}
        numbers = ", ".join(f"if({b}, '{rule_number(rule)}', null)" for rule, b in broken.items())
        fault = _struct("", "cast(null as bigint)", "cast(null as bigint)", f"concat_ws(',', {numbers})", False)
        lines.append(f"if({' or '.join(broken.values())}, {fault}, null)")
    lines_of = t.table(name).selectExpr(f"explode(array({', '.join(lines)})) as line").filter("line is not null")
    return lines_of.selectExpr("line.*", "1L as n")


def value_counts(t: FreightTables, single: bool = True) -> DataFrame:
    """``n`` and ``parents`` by rule and value, over all tables in one shuffle. Counts are folded before it, so a value held
    by a third of the rows is one row per task."""
    asked = [n for n in t.names() if single or TABLES[n].references or n in {p for _, _, p in reference_rules().values()}]
    return totals(_union([_lines(t, name, single) for name in asked]), VALUE, *COUNTS)


def violations(counts: DataFrame, rules: list[str]) -> DataFrame:
    """rule and violations from ``value_counts``: rows that break it, keys that occur more than once, or orphans."""
    sums = totals(
        counts.selectExpr("*", f"if(rule = {rule_number('')}, text, null) as broken"),
        ["rule", "broken"],
        "sum(n) as rows",
        "count_if(n > 1) as repeated",
        "sum(if(parents = 0, n, 0L)) as orphans",
        "count_if(parents > 1) as repeated_parents",
    )
    named = ", ".join(f"{rule_number(rule)}, '{rule}'" for rule in rules)
    keys = ", ".join(f"{rule_number(rule)}, '{key}'" for key, rule in keys_counted_by().items() if key in rules)
    key = f"try_element_at(map({keys}), rule)" if keys else "cast(null as string)"
    kind = (
        "case when contains(rule, '|unique: ') then repeated when contains(rule, '|reference: ') then orphans else rows end"
    )
    return (
        sums.selectExpr(
            "* except (rule, broken)",
            f"{key} as key",
            "explode(if(broken is null, array(rule), cast(split(broken, ',') as array<int>))) as rule",
        )
        .selectExpr("* except (rule)", f"try_element_at(map({named}), rule) as rule")
        .selectExpr(f"stack(2, rule, {kind}, key, repeated_parents) as (rule, violations)")
        .filter("rule is not null")
    )


def reference_orphans(t: FreightTables) -> DataFrame:
    """Rows per foreign key whose value is no key of the parent table; NULL refers to nothing.

    All keys share one pass and one shuffle: references are counted by value together with the parents' keys.
    """
    rules = list(reference_rules())
    found = violations(value_counts(t, single=False), rules).selectExpr(
        "upper(substring_index(rule, '|', 1)) || '.' || substring_index(rule, '|reference: ', -1) as fk",
        "violations as orphans",
    )
    names = [f"{child.upper()}.{column}" for child, column, _ in reference_rules().values()]
    return _reported(found, "fk", names, "orphans").orderBy("fk")


# -- constraints -------------------------------------------------------------


def _status_audit(t: FreightTables) -> DataFrame:
    """Shipments whose status cannot go with that of their voyage; cancelled ones are exempt."""
    allowed = " or ".join(
        f"(voyage_status = '{voyage}' and status in ({_quoted(statuses)}))"
        for voyage, statuses in SHIPMENT_STATUS_OF_VOYAGE.items()
    )
    # One row per voyage and status meets the voyages, however many shipments a voyage carries.
    carried = totals(t.shipment, ["voyage_id", "status"], "count(*) as n")
    broken = totals(
        carried.join(t.voyage.selectExpr("voyage_id", "status as voyage_status"), "voyage_id"),
        [],
        f"sum(if(status <> 'Cancelled' and not ({allowed}), n, 0)) as violations",
    )
    return broken.selectExpr(
        "'shipment' as table_name", "'status agrees with voyage' as rule", "coalesce(violations, 0) as violations"
    )


def named_rules(report: DataFrame) -> DataFrame:
    """table_name, rule and violations of rules that are named with their table."""
    return report.selectExpr(
        "substring_index(rule, '|', 1) as table_name", "substring_index(rule, '|', -1) as rule", "violations"
    )


def constraint_audit(t: FreightTables) -> DataFrame:
    """Every declared constraint with the number of violations; all are zero on clean data.

    Each table is read once for all rules but that on statuses, which reads shipments and voyages again.
    """
    rules = [*row_rules(t.names()), *unique_rules(t.names()), *reference_rules()]
    found = _reported(violations(value_counts(t), rules), "rule", rules, "violations")
    return named_rules(found).unionByName(_status_audit(t))


# -- verification reports ----------------------------------------------------


def fleet_roster(t: FreightTables) -> DataFrame:
    """Vessels with their voyages and completed voyages."""
    completed = tally("status = 'Completed'")
    voyages = totals(t.voyage, ["vessel_id"], "count(*) as voyages", f"{completed} as completed")
    return (
        t.vessel.join(voyages, "vessel_id", "left")
        .selectExpr(
            "vessel_name",
            "operator",
            "vessel_type",
            "teu_capacity",
            "flag_state",
            "coalesce(voyages, 0) as total_voyages",
            "coalesce(completed, 0) as completed_voyages",
        )
        .orderBy(F.desc("total_voyages"), "vessel_name")
    )


def route_map_summary(t: FreightTables) -> DataFrame:
    """Routes with named end points, legs and miles."""
    return (
        t.route.join(port_role(t, "origin", "un_locode", "port_name"), "origin_port_id")
        .join(port_role(t, "dest", "un_locode", "port_name"), "dest_port_id")
        .join(leg_totals(t), "route_id", "left")
        .selectExpr(
            "route_name",
            "service_name",
            "transit_days",
            "origin_un_locode as origin_locode",
            "origin_port_name as origin_port",
            "dest_un_locode as dest_locode",
            "dest_port_name as dest_port",
            "coalesce(legs, 0) as leg_count",
            "total_distance_nm",
        )
        .orderBy(F.desc("transit_days"), "route_name")
    )


def voyage_schedule(t: FreightTables, rows: int = TOP_ROWS) -> DataFrame:
    """The first departures with vessel, route, stops and delay.

    The dimensions only filter (every voyage has one vessel and one route), so the top rows are chosen before the
    stops are summed: the stops of these voyages are all that is aggregated.
    """
    first = (
        t.voyage.join(t.vessel.select("vessel_id", "vessel_name"), "vessel_id")
        .join(t.route.select("route_id", "route_name"), "route_id")
        .orderBy("departure_date", "voyage_id")
        .limit(rows)
    )
    stops = totals(
        t.voyage_stop.join(first.select("voyage_id"), "voyage_id", "left_semi"),
        ["voyage_id"],
        "count(*) as stops",
        f"{half_up(exact_mean('delay_hours'), 1)} as avg_delay_hours",
        f"{half_up('max(delay_hours)', 1)} as max_delay_hours",
    )
    return (
        first.join(stops, "voyage_id", "left")
        .orderBy("departure_date", "voyage_id")
        .selectExpr(
            "voyage_number",
            "vessel_name",
            "route_name",
            "status",
            "departure_date",
            "arrival_date",
            "coalesce(stops, 0) as stop_count",
            "avg_delay_hours",
            "max_delay_hours",
        )
    )


def commercial_chain(t: FreightTables, rows: int = TOP_ROWS) -> DataFrame:
    """The shipments with the most valuable cargo, with ports, containers and cargo totals."""
    per_container = totals(
        t.cargo_item,
        ["container_id"],
        "count(*) as lines",
        f"{exact_sum('weight_kg')} as kg",
        f"{exact_sum('value_usd')} as usd",
    )
    per_shipment = totals(
        t.container.select("container_id", "shipment_id").join(per_container, "container_id", "left"),
        ["shipment_id"],
        "count(*) as boxes",
        "sum(lines) as lines",
        f"{half_up('cast(sum(kg) as double)', 0)} as total_cargo_kg",
        f"{half_up('cast(sum(usd) as double)', 0)} as total_cargo_usd",
    )
    return (
        t.shipment.join(per_shipment, "shipment_id", "left")
        .join(t.customer.select("customer_id", "company_name"), "customer_id")
        .join(port_role(t, "origin", "un_locode"), "origin_port_id")
        .join(port_role(t, "dest", "un_locode"), "dest_port_id")
        .orderBy(F.desc("total_cargo_usd"), "shipment_id")
        .limit(rows)
        .selectExpr(
            "bl_number",
            "company_name as customer",
            "origin_un_locode as origin",
            "dest_un_locode as destination",
            "incoterms",
            "status",
            "coalesce(boxes, 0) as containers",
            "coalesce(lines, 0) as cargo_lines",
            "total_cargo_kg",
            "total_cargo_usd",
        )
    )


def longest_chain(t: FreightTables) -> DataFrame:
    """Timeline of the shipment with the most events; the lowest bill of lading wins a tie."""
    counts = totals(t.shipment_event, ["shipment_id"], "count(*) as events")
    longest = (
        t.shipment.select("shipment_id", "bl_number")
        .join(counts, "shipment_id")
        .orderBy(F.desc("events"), "bl_number")
        .limit(1)
    )
    return (
        t.shipment_event.join(longest.select("shipment_id"), "shipment_id")
        .join(t.port.select("port_id", "un_locode", "port_name"), "port_id", "left")
        .orderBy("event_timestamp", "event_id")
        .selectExpr(
            "event_timestamp", "event_type", "un_locode as port", "port_name", "description", "created_by"
        )
    )


# -- rules -------------------------------------------------------------------


def voyage_status_audit(t: FreightTables, as_of: str) -> DataFrame:
    """Stored status of each voyage next to the status its dates imply at ``as_of``, a timestamp expression."""
    expected = voyage_status("departure_date", "arrival_date", as_of)
    return t.voyage.selectExpr("voyage_id", "voyage_number", "status", f"{expected} as expected_status").selectExpr(
        "*", "if(status = expected_status, 1, 0) as agrees"
    )


VOYAGE_STATUSES = ("Scheduled", "Departed", "In Transit", "Arrived", "Completed")


def voyage_status_over_time(t: FreightTables, start: str, step: str, times: int) -> DataFrame:
    """Voyages in each status at ``times`` moments, ``step`` (an interval) apart from ``start`` (a timestamp) on.

    Every moment counts as the audit at that moment would. A voyage enters a status at one moment and leaves it at
    another: it adds 1 at the first and takes 1 away at the second, and a running sum over the moments gives the counts.
    The deltas are summed per (status, moment) map-side, so the work is one pass over the voyages however many moments
    are asked for, and the window sees ``times`` rows per status. A missing date is passed over, as in the audit.
    """
    entered = [
        "departure_date",
        "departure_date + interval 6 hours",
        "arrival_date",
        "arrival_date + interval 3 days",
    ]
    # Each status ends where the next begins, not before the ones ahead of it did; greatest passes over NULL.
    entered = [f"greatest({', '.join(entered[:n])})" if n > 1 else entered[0] for n in range(1, 5)]
    micros = "(unix_micros(cast({0} as timestamp)) - unix_micros(cast({1} as timestamp)))"
    width = micros.format(f"({start} + {step})", start)
    # Number of the first moment at or after the time; without one the status began before all moments.
    firsts = [
        f"greatest(0L, least({times}L, coalesce(cast(ceil({micros.format(e, start)} / {width}) as bigint), 0L)))"
        for e in entered
    ]
    begins, ends = ["0L", *firsts], [*firsts, f"{times}L"]
    deltas = ", ".join(
        f"'{status}', {moment}, {sign}"
        for status, begin, end in zip(VOYAGE_STATUSES, begins, ends)
        for moment, sign in ((begin, "1L"), (end, "-1L"))
    )
    changes = t.voyage.selectExpr(f"stack({2 * len(VOYAGE_STATUSES)}, {deltas}) as (status, moment, delta)")
    summed = totals(changes.filter(f"moment < {times}"), ["status", "moment"], "sum(delta) as delta")
    moments = t.spark.range(times).selectExpr("id as moment", f"explode(array({_quoted(VOYAGE_STATUSES)})) as status")
    return (
        moments.join(summed, ["status", "moment"], "left")
        .selectExpr(
            f"{start} + {step} * moment as seen_at",
            "status",
            "sum(coalesce(delta, 0L)) over (partition by status order by moment rows unbounded preceding) as voyages",
        )
        .orderBy("seen_at", "status")
    )


# What a shipment in a status without a chain of its own has had.
UNKNOWN_CHAIN = ("Booking Confirmed",)


def event_chain_audit(t: FreightTables) -> DataFrame:
    """Tracking events of each shipment against the chain its status calls for.

    Events are reduced to the first time per (shipment, type) before they are lined up, so a shipment never holds
    more entries than there are event types. Reports missing and extra types, whether the expected ones came in
    order, and whether the shipment conforms; a customs hold may occur anywhere.
    """
    first = totals(
        t.shipment_event,
        ["shipment_id", "event_type"],
        "min(struct(event_timestamp, event_id)) as at",
        "count(*) as n",
    )
    seen = totals(
        first,
        ["shipment_id"],
        "transform(array_sort(collect_list(struct(at, event_type))), e -> e.event_type) as found",
        "sum(n) as event_count",
    )
    chains = " ".join(f"when '{status}' then array({_quoted(chain)})" for status, chain in EVENT_CHAINS.items())
    return (
        t.shipment.selectExpr("shipment_id", "bl_number", "status", f"case status {chains} else array({_quoted(UNKNOWN_CHAIN)}) end as expected")
        .join(seen, "shipment_id", "left")
        .selectExpr(
            "bl_number",
            "status",
            "expected",
            "coalesce(event_count, 0) as event_count",
            "coalesce(found, cast(array() as array<string>)) as found",
        )
        .selectExpr(
            "*",
            "array_sort(array_except(expected, found)) as missing_types",
            f"array_sort(array_except(found, array_union(expected, array({_quoted(OPTIONAL_EVENTS)})))) as extra_types",
            "filter(found, e -> array_contains(expected, e)) = filter(expected, e -> array_contains(found, e)) "
            "as ordered",
        )
        .selectExpr(
            "bl_number",
            "status",
            "event_count",
            "array_join(missing_types, ', ') as missing",
            "array_join(extra_types, ', ') as extra",
            "if(ordered, 1, 0) as in_order",
            "if(ordered and size(missing_types) = 0 and size(extra_types) = 0, 1, 0) as conforms",
        )
    )


def check_digit_audit(t: FreightTables) -> DataFrame:
    """Last digit of each container number against the check digit of the rest."""
    return t.container.selectExpr(
        "container_id",
        "container_number",
        f"cast({check_digit('left(container_number, length(container_number) - 1)')} as bigint) as expected_digit",
    ).selectExpr("*", "if(right(container_number, 1) = cast(expected_digit as string), 1, 0) as valid")
