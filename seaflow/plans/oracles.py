"""SQL for DuckDB that states each registered query over the source tables, independently of the DataFrame code."""

from __future__ import annotations

from seaflow.operators.querylog import BLOCKED_WORDS, OPEN_CLAUSES
from seaflow.sources.fixtures import AS_OF
from seaflow.sources.schema import (
    EVENT_CHAINS,
    OPTIONAL_EVENTS,
    SHIPMENT_STATUS_OF_VOYAGE,
    TABLES,
)

# The freight views of FIXTURES.md section 3. ``main.customer`` is the source table, hidden by our view elsewhere.
VIEWS = f"""
port as (
  select cast(n_nationkey as bigint) as port_id,
         upper(substr(r_name, 1, 2)) || lpad(cast(n_nationkey as varchar), 3, '0') as un_locode,
         n_name as port_name, upper(substr(r_name, 1, 2)) as country_code,
         cast((n_nationkey * 37) % 181 - 90 as double) as latitude,
         cast((n_nationkey * 53) % 361 - 180 as double) as longitude,
         'UTC' as timezone, case when n_nationkey % 4 = 0 then 1 else 0 end as is_transshipment
  from nation join region on n_regionkey = r_regionkey),
vessel as (
  select s_suppkey as vessel_id, 'IMO' || lpad(cast(s_suppkey as varchar), 12, '0') as imo_number,
         s_name as vessel_name,
         case s_suppkey % 8 when 5 then 'Bulk Carrier' when 6 then 'Tanker' when 7 then 'RoRo'
           else 'Container' end as vessel_type,
         n_name as flag_state, 60000 + (s_suppkey * 7919) % 140000 as gross_tonnage,
         case when s_suppkey % 8 >= 5 then null else 5 + (s_suppkey * 613) % 160 end as teu_capacity,
         cast(2000 + s_suppkey % 20 as integer) as year_built,
         'Operator ' || cast(s_nationkey as varchar) as operator
  from supplier join nation on s_nationkey = n_nationkey),
route as (
  select cast(n_nationkey as bigint) as route_id, 'Lane ' || n_name as route_name,
         cast(n_nationkey as bigint) as origin_port_id,
         cast((n_nationkey + 2 * (1 + n_nationkey % 3)) % 25 as bigint) as dest_port_id,
         'Service ' || cast(n_regionkey as varchar) as service_name,
         7 + (n_nationkey * 5) % 29 as transit_days
  from nation),
route_leg as (
  select cast(n_nationkey * 10 + seq as bigint) as leg_id, cast(n_nationkey as bigint) as route_id,
         seq as leg_sequence, cast((n_nationkey + 2 * (seq - 1)) % 25 as bigint) as from_port_id,
         cast((n_nationkey + 2 * seq) % 25 as bigint) as to_port_id,
         200 + (n_nationkey * 997 + seq * 613) % 9000 as distance_nm, (n_nationkey + seq) % 14 as typical_days
  from nation cross join (values (1), (2), (3)) as s(seq)
  where seq <= 1 + n_nationkey % 3 and n_nationkey <> 24),
voyage as (
  select voyage_id, 'V' || lpad(cast(voyage_id as varchar), 12, '0') as voyage_number, vessel_id, route_id,
         departure_date, arrival_date,
         case when timestamp '{AS_OF}' < departure_date then 'Scheduled'
           when timestamp '{AS_OF}' < departure_date + interval '6' hour then 'Departed'
           when timestamp '{AS_OF}' < arrival_date then 'In Transit'
           when timestamp '{AS_OF}' < arrival_date + interval '3' day then 'Arrived'
           else 'Completed' end as status
  from (select x.*, departure_date + transit_days * interval '1' day as arrival_date
        from (select p_partkey as voyage_id, p_partkey % (select count(*) - 1 from supplier) as vessel_id,
                     p_partkey % 23 as route_id,
                     timestamp '1995-01-01 00:00:00' + ((p_partkey * 37) % 2400) * interval '1' day
                       + (4 + p_partkey % 18) * interval '1' hour as departure_date
              from part) x join route using (route_id))),
voyage_stop as (
  select voyage_id * 1000000000 + stop_sequence as stop_id, voyage_id, port_id, stop_sequence, eta,
         case when is_open then null else eta + cast(delay_hours * 60 as bigint) * interval '1' minute end as ata,
         eta + interval '8' hour as etd,
         case when is_open then null
           else eta + interval '8' hour + cast(delay_hours * 60 as bigint) * interval '1' minute end as atd,
         delay_hours
  from (select l_partkey as voyage_id, l_orderkey % 24 as port_id,
               cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey,
                 l_shipdate, l_quantity, l_extendedprice, l_tax) as integer) as stop_sequence,
               l_shipdate as eta, l_linestatus = 'O' and l_returnflag = 'N' as is_open,
               case when l_quantity <= 20 then 0.0e0 else (l_quantity - 20) * 1.25e0 end as delay_hours
        from lineitem)),
customer as (
  select c_custkey as customer_id, c_name as company_name, n_name as country_code, c_mktsegment as industry,
         c_name || '@example.com' as contact_email, c_acctbal as credit_limit, 1 as is_active
  from main.customer join nation on c_nationkey = n_nationkey),
shipment as (
  select o_orderkey as shipment_id, 'BL' || lpad(cast(o_orderkey as varchar), 12, '0') as bl_number,
         o_custkey as customer_id, voyage_id, origin_port_id, dest_port_id,
         ['EXW', 'FCA', 'FAS', 'FOB', 'CFR', 'CIF', 'CPT', 'CIP', 'DAP', 'DPU', 'DDP'][o_orderkey % 11 + 1]
           as incoterms,
         case when o_orderpriority = '5-LOW' and o_orderstatus = 'O' then 'Cancelled'
           when o_orderstatus = 'O' then 'Booked'
           when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 'Loaded'
           when o_orderstatus = 'P' then 'In Transit'
           when o_orderpriority = '1-URGENT' then 'Arrived' else 'Delivered' end as status,
         o_orderdate as booking_date, cast(5000 + (o_orderkey * 7919) % 20000 as double) as total_weight_kg,
         o_totalprice as total_value_usd
  from (select *, o_orderkey % (select count(*) - 10 from part) as voyage_id from orders) o
  join route on route_id = o.voyage_id % 23),
container as (
  select l_orderkey * 10 + l_linenumber as container_id,
         'MSCU' || lpad(cast(l_orderkey * 10 + l_linenumber as varchar), 14, '0') as container_number,
         l_orderkey as shipment_id, container_type, cast(2200 + (k % 7) * 250 as double) as tare_weight_kg,
         cast(21000 + (k % 7) * 900 as double) as max_payload_kg,
         case when container_type like '%RF' then 1 else 0 end as is_reefer,
         case when container_type like '%RF' then cast(k % 30 - 25 as double) end as temperature_c,
         'SL' || cast(100000 + k % 900000 as varchar) as seal_number
  from (select l_orderkey, l_linenumber, min(l_partkey) as k,
               ['20GP', '40GP', '40HC', '20RF', '40RF', '20OT', '40OT'][min(l_partkey) % 7 + 1] as container_type
        from lineitem where l_orderkey % 10 <> 9 group by l_orderkey, l_linenumber)),
cargo_item as (
  select (l_orderkey * 10 + l_linenumber) * 1000000 + row_number() over (partition by l_orderkey, l_linenumber
           order by l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_tax) as cargo_id,
         l_orderkey * 10 + l_linenumber as container_id, lpad(cast(l_partkey as varchar), 6, '0') as hs_code,
         p_name as description, cast(l_quantity as integer) as quantity, 'units' as unit,
         l_quantity * 2.5e0 as weight_kg, l_extendedprice as value_usd
  from lineitem join part on p_partkey = l_partkey where l_orderkey % 10 <> 9 and l_linenumber <> 7),
shipment_event as (
  select event_id, (event_id * 7) % (select count(*) from orders) as shipment_id,
         ['Booking Confirmed', 'Documents Received', 'Gate In', 'Loaded on Vessel', 'Vessel Departed',
          'Port Arrival', 'Customs Hold', 'Customs Cleared', 'Gate Out', 'Delivered', 'Exception',
          'Cancelled'][(event_id * 5 + user_id) % 12 + 1] as event_type,
         ts as event_timestamp, case when event_id % 10 = 0 then null else user_id % 25 end as port_id,
         event_type || ' ' || cast(event_id as varchar) as description, 'SYSTEM' as created_by
  from events)"""


def _round(value: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(floor(abs({value}) * {scale} + 0.5e0) / {scale} * sign({value}))"


def _pct(part: str, whole: str, digits: int = 1) -> str:
    return _round(f"(cast({part} as double) * 100e0 / nullif(cast({whole} as double), 0))", digits)


def _sum(column: str) -> str:
    return f"sum(cast({column} as decimal(18,2)))"


def _dsum(column: str) -> str:
    return f"cast({_sum(column)} as double)"


def _mean(column: str, digits: int = 2) -> str:
    return _round(f"({_dsum(column)} / nullif(count({column}), 0))", digits)


def _big(value: str) -> str:
    return f"cast({value} as bigint)"


ON_TIME = "ata is not null and delay_hours <= 4"
LATE = "ata is not null and delay_hours > 4"
SEVERE = "ata is not null and delay_hours > 24"


def _count(condition: str) -> str:
    return f"count(*) filter (where {condition})"


OTP = _pct(_count(ON_TIME), "count(ata)")

# Queries that several others build on, as text without the views.
UTILIZATION = f"""
select vessel_name, operator, teu_capacity, year_built, count(voyage_id) as total_voyages,
       {_count("status = 'Completed'")} as completed, {_count("status in ('In Transit', 'Departed')")} as active,
       {_count("status = 'Scheduled'")} as scheduled, {_count("status = 'Arrived'")} as arrived
from vessel left join voyage using (vessel_id)
group by vessel_id, vessel_name, operator, teu_capacity, year_built"""

CAPACITY = f"""
select vessel_name, operator, teu_capacity, voyage_number, voyage.status, count(container_id) as container_count,
       {_big("sum(case when container_type like '40%' then 2 else 1 end)")} as booked_teu,
       {_pct("sum(case when container_type like '40%' then 2 else 1 end)", "teu_capacity")} as utilization_pct
from voyage join vessel using (vessel_id)
left join shipment using (voyage_id) left join container using (shipment_id)
group by voyage_id, vessel_name, operator, teu_capacity, voyage_number, voyage.status"""

BUSIEST = f"""
select port_name, un_locode, country_code, is_transshipment, count(stop_id) as total_calls,
       count(distinct voyage_id) as distinct_voyages,
       any_value((select count(*) from shipment s where s.origin_port_id = p.port_id)) as outbound_shipments,
       any_value((select count(*) from shipment s where s.dest_port_id = p.port_id)) as inbound_shipments,
       {_round("avg(delay_hours)", 2)} as avg_delay_h
from port p left join voyage_stop vs on vs.port_id = p.port_id
group by p.port_id, port_name, un_locode, country_code, is_transshipment"""

ROUTE_DELAY = f"""
select route_name, service_name, transit_days as scheduled_transit_days, count(distinct voyage_id) as voyage_count,
       count(*) as total_stops, {_round("avg(delay_hours)", 2)} as avg_delay_h,
       {_round("max(delay_hours)", 2)} as max_delay_h, {_count("delay_hours > 24")} as stops_over_24h,
       {OTP} as otp_pct
from voyage_stop join voyage using (voyage_id) join route using (route_id)
group by route_id, route_name, service_name, transit_days"""

LEGS = f"""
select route_name, service_name, leg_sequence, a.port_name as from_port, a.un_locode as from_locode,
       a.country_code as from_country, b.port_name as to_port, b.un_locode as to_locode,
       b.country_code as to_country, distance_nm, typical_days,
       {_round("(distance_nm / nullif(cast(typical_days as double), 0))", 0)} as avg_speed_nm_per_day
from route_leg join route using (route_id)
join port a on a.port_id = from_port_id join port b on b.port_id = to_port_id"""

PUNCTUALITY = f"""
select count(*) as total_stops, count(ata) as completed_stops, count(*) - count(ata) as pending_stops,
       {_count(ON_TIME)} as on_time, {_count(LATE)} as delayed, {_count(SEVERE)} as severely_delayed,
       {OTP} as otp_pct, {_round("avg(delay_hours) filter (where ata is not null)", 2)} as avg_delay_h,
       {_round("max(delay_hours)", 2)} as max_delay_h
from voyage_stop"""

DELAYED = f"""
select voyage_number, status, vessel_name, operator, route_name, departure_date, arrival_date,
       count(*) as stop_count, {_round("sum(delay_hours)", 2)} as total_delay_h,
       {_round("avg(delay_hours)", 2)} as avg_delay_h, {_round("max(delay_hours)", 2)} as max_stop_delay_h,
       {_count("delay_hours > 24")} as stops_over_24h
from voyage_stop join voyage using (voyage_id) join vessel using (vessel_id) join route using (route_id)
group by voyage_id, voyage_number, status, vessel_name, operator, route_name, departure_date, arrival_date
having sum(delay_hours) > 24"""

PORT_DELAY = f"""
select port_name, un_locode, country_code, latitude, longitude, is_transshipment, count(*) as total_calls,
       count(ata) as arrived_calls, {_round("avg(delay_hours) filter (where ata is not null)", 2)} as avg_delay_h,
       {_round("max(delay_hours)", 2)} as max_delay_h, {_count(LATE)} as delayed_arrivals,
       {_count(SEVERE)} as severe_delays, {OTP} as otp_pct
from voyage_stop join port using (port_id)
group by port_id, port_name, un_locode, country_code, latitude, longitude, is_transshipment"""

CUSTOMERS = f"""
select company_name, country_code, industry, count(*) as shipment_count,
       {_dsum("total_value_usd")} as total_value_usd, {_mean("total_value_usd")} as avg_shipment_value_usd,
       {_dsum("total_weight_kg")} as total_weight_kg, count(distinct voyage_id) as voyages_used,
       count(distinct status) as status_variety
from shipment join customer using (customer_id)
group by customer_id, company_name, country_code, industry"""

LANES = f"""
select route_name, service_name, a.port_name as origin_port, b.port_name as dest_port,
       count(*) as shipment_count, count(distinct customer_id) as customer_count,
       {_dsum("total_value_usd")} as total_value_usd, {_mean("total_value_usd")} as avg_value_usd,
       {_dsum("total_weight_kg")} as total_weight_kg, {_mean("total_weight_kg")} as avg_weight_kg
from shipment join voyage using (voyage_id) join route r using (route_id)
join port a on a.port_id = r.origin_port_id join port b on b.port_id = r.dest_port_id
group by route_id, route_name, service_name, a.port_name, b.port_name"""

STATUSES = f"""
select status, count(*) as shipment_count,
       {_pct("count(*)", "sum(count(*)) over ()")} as pct_of_total,
       {_dsum("total_value_usd")} as total_value_usd, {_mean("total_value_usd")} as avg_value_usd,
       {_dsum("total_weight_kg")} as total_weight_kg, {_mean("total_weight_kg")} as avg_weight_kg
from shipment group by status"""

REEFER_TYPES = f"""
select container_type, count(*) as total_containers, {_big("sum(is_reefer)")} as reefer_count,
       {_count("is_reefer = 0")} as dry_count, {_pct("sum(is_reefer)", "count(*)")} as reefer_pct,
       {_round("avg(temperature_c) filter (where is_reefer = 1)", 1)} as avg_temp_c,
       {_round("min(temperature_c) filter (where is_reefer = 1)", 1)} as min_temp_c,
       {_round("max(temperature_c) filter (where is_reefer = 1)", 1)} as max_temp_c
from container group by container_type"""

REEFERS = f"""
select count(*) as total_containers, {_big("sum(is_reefer)")} as reefer_containers,
       {_count("is_reefer = 0")} as dry_containers, {_pct("sum(is_reefer)", "count(*)")} as reefer_pct,
       {_round("avg(temperature_c) filter (where is_reefer = 1)", 1)} as avg_reefer_temp_c,
       {_round("min(temperature_c) filter (where is_reefer = 1)", 1)} as min_temp_c,
       {_round("max(temperature_c) filter (where is_reefer = 1)", 1)} as max_temp_c
from container"""

KPIS = {
    "fleet": {"vessel_utilization": UTILIZATION, "capacity_vs_booked_teu": CAPACITY},
    "network": {"busiest_ports": BUSIEST, "avg_delay_by_route": ROUTE_DELAY, "leg_distances": LEGS},
    "operations": {
        "on_time_performance": PUNCTUALITY,
        "delayed_voyages": DELAYED,
        "avg_delay_by_port": PORT_DELAY,
    },
    "commercial": {
        "top_customers_by_value": CUSTOMERS,
        "revenue_by_trade_lane": LANES,
        "shipment_status_breakdown": STATUSES,
        "reefer_by_type": REEFER_TYPES,
        "reefer_summary": REEFERS,
    },
}

# The texts and the numbers of each KPI.
KPI_COLUMNS = {
    "vessel_utilization": (
        "vessel_name operator",
        "teu_capacity year_built total_voyages completed active scheduled arrived",
    ),
    "capacity_vs_booked_teu": (
        "vessel_name operator voyage_number status",
        "teu_capacity container_count booked_teu utilization_pct",
    ),
    "busiest_ports": (
        "port_name un_locode country_code",
        "is_transshipment total_calls distinct_voyages outbound_shipments inbound_shipments avg_delay_h",
    ),
    "avg_delay_by_route": (
        "route_name service_name",
        "scheduled_transit_days voyage_count total_stops avg_delay_h max_delay_h stops_over_24h otp_pct",
    ),
    "leg_distances": (
        "route_name service_name from_port from_locode from_country to_port to_locode to_country",
        "leg_sequence distance_nm typical_days avg_speed_nm_per_day",
    ),
    "on_time_performance": (
        "",
        "total_stops completed_stops pending_stops on_time delayed severely_delayed otp_pct avg_delay_h max_delay_h",
    ),
    "delayed_voyages": (
        "voyage_number status vessel_name operator route_name",
        "stop_count total_delay_h avg_delay_h max_stop_delay_h stops_over_24h",
    ),
    "avg_delay_by_port": (
        "un_locode port_name country_code",
        "latitude longitude is_transshipment total_calls arrived_calls avg_delay_h max_delay_h delayed_arrivals "
        "severe_delays otp_pct",
    ),
    "top_customers_by_value": (
        "company_name country_code industry",
        "shipment_count total_value_usd avg_shipment_value_usd total_weight_kg voyages_used status_variety",
    ),
    "revenue_by_trade_lane": (
        "route_name service_name origin_port dest_port",
        "shipment_count customer_count total_value_usd avg_value_usd total_weight_kg avg_weight_kg",
    ),
    "shipment_status_breakdown": (
        "status",
        "shipment_count pct_of_total total_value_usd avg_value_usd total_weight_kg avg_weight_kg",
    ),
    "reefer_by_type": (
        "container_type",
        "total_containers reefer_count dry_count reefer_pct avg_temp_c min_temp_c max_temp_c",
    ),
    "reefer_summary": (
        "",
        "total_containers reefer_containers dry_containers reefer_pct avg_reefer_temp_c min_temp_c max_temp_c",
    ),
}


def _kpi_values(category: str, kpi: str, sql: str) -> str:
    texts, numbers = (names.split() for names in KPI_COLUMNS[kpi])
    key = f"concat_ws('|', {', '.join(texts)})" if texts else "''"
    values = ", ".join(f"cast({n} as double) as {n}" for n in numbers)
    return (
        f"select '{category}' as category, '{kpi}' as kpi, key, measure, value from (select {key} as key, {values} "
        f"from ({sql})) unpivot include nulls (value for measure in ({', '.join(numbers)}))"
    )


KPI_VALUES = " union all ".join(
    _kpi_values(category, kpi, sql) for category, kpis in KPIS.items() for kpi, sql in kpis.items()
)

SHIPMENT_LIST = f"""
select bl_number, company_name as customer, route_name as trade_lane, a.un_locode as origin,
       b.un_locode as destination, incoterms, s.status, v.status as voyage_status, booking_date,
       {_round("total_weight_kg", 0)} as weight_kg, {_round("total_value_usd", 0)} as value_usd
from shipment s join customer using (customer_id) join voyage v using (voyage_id) join route r using (route_id)
join port a on a.port_id = s.origin_port_id join port b on b.port_id = s.dest_port_id"""

HELD = """(select shipment_id from shipment_event where event_type = 'Customs Hold')"""

PORT_VOLUME = f"""
select p.port_id, port_name, un_locode, country_code, latitude, longitude, is_transshipment,
       count(stop_id) as total_calls, count(distinct voyage_id) as distinct_voyages,
       {_round("avg(delay_hours)", 1)} as avg_delay_h
from port p left join voyage_stop vs on vs.port_id = p.port_id
group by p.port_id, port_name, un_locode, country_code, latitude, longitude, is_transshipment"""

ORPHANS = " union all ".join(
    f"select '{spec.name.upper()}.{column}' as fk, count(*) as orphans from {spec.name} "
    f"where {column} is not null and {column} not in (select {TABLES[parent].key} from {parent})"
    for spec in TABLES.values()
    for column, parent in spec.references.items()
)


def _constraint_rules() -> str:
    def quoted(values: tuple) -> str:
        return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)

    def line(table: str, rule: str, source: str) -> str:
        return f"select '{table}' as table_name, '{rule}' as rule, count(*) as violations from {source}"

    lines = []
    for name, spec in TABLES.items():
        lines += [line(name, f"not null: {c}", f"{name} where {c} is null") for c in spec.required]
        lines += [
            line(name, f"domain: {c}", f"{name} where {c} not in ({quoted(domain)})")
            for c, domain in spec.domains.items()
        ]
        for columns in ((spec.key,), *spec.unique):
            keys = ", ".join(columns)
            present = " and ".join(f"{c} is not null" for c in columns)
            lines.append(
                line(
                    name,
                    f"unique: {keys}",
                    f"(select {keys} from {name} where {present} group by {keys} having count(*) > 1)",
                )
            )
        lines += [
            line(
                name,
                f"reference: {c}",
                f"{name} x where x.{c} is not null and not exists "
                f"(select 1 from {parent} y where y.{TABLES[parent].key} = x.{c})",
            )
            for c, parent in spec.references.items()
        ]
    allowed = " or ".join(
        f"(v.status = '{voyage}' and s.status in ({quoted(statuses)}))"
        for voyage, statuses in SHIPMENT_STATUS_OF_VOYAGE.items()
    )
    lines.append(
        line(
            "shipment",
            "status agrees with voyage",
            f"shipment s join voyage v using (voyage_id) where s.status <> 'Cancelled' and not ({allowed})",
        )
    )
    return " union all ".join(lines)


def _event_chains() -> str:
    chains = " union all ".join(
        f"select '{status}' as status, [{', '.join(repr(e) for e in chain)}] as expected"
        for status, chain in EVENT_CHAINS.items()
    )
    optional = ", ".join(f"'{e}'" for e in OPTIONAL_EVENTS)
    return f"""
select bl_number, status, coalesce(event_count, 0) as event_count,
       array_to_string(missing, ', ') as missing, array_to_string(extra, ', ') as extra,
       cast(in_order as integer) as in_order,
       cast(len(missing) = 0 and len(extra) = 0 and in_order as integer) as conforms
from (select bl_number, s.status, event_count,
             list_sort(list_filter(expected, lambda e: not list_contains(found, e))) as missing,
             list_sort(list_filter(found, lambda e: not list_contains(expected, e) and e not in ({optional})))
               as extra,
             list_filter(found, lambda e: list_contains(expected, e))
               = list_filter(expected, lambda e: list_contains(found, e)) as in_order
      from (select shipment.*, event_count, coalesce(found, cast([] as varchar[])) as found
            from shipment left join (
              select shipment_id, {_big("sum(n)")} as event_count,
                     list(event_type order by event_timestamp, event_id) as found
              from (select shipment_id, event_type, event_timestamp, event_id,
                           count(*) over (partition by shipment_id, event_type) as n,
                           row_number() over (partition by shipment_id, event_type
                                              order by event_timestamp, event_id) as nth
                    from shipment_event)
              where nth = 1 group by shipment_id) using (shipment_id)) s
      left join (select status as known, expected as listed from ({chains})) c on known = s.status
      cross join lateral (select coalesce(listed, ['Booking Confirmed']) as expected) x)"""


# Texts for the SQL audit; the RE2 patterns stand for the Java ones of the library.
QUERY_LOG = """
select event_id as query_id, case event_id % 20
  when 0 then 'DELETE FROM shipment WHERE shipment_id = ' || n
  when 1 then 'SELECT eta FROM voyage_stop -- note ' || n
  when 2 then 'SELECT /* ' || n || ' */ route_name FROM route'
  when 3 then 'SELECT ' || n || '; DROP VIEW route'
  when 4 then 'describe route'
  when 5 then '  ' || chr(10) || chr(9) || ' '
  when 6 then 'select route_name, service_name from route where route_id = ' || n
  when 7 then 'WITH legs AS (SELECT route_id FROM route_leg) SELECT * FROM legs LIMIT ' || n
  when 8 then 'SELECT c.company_name, s.bl_number FROM customer c JOIN shipment s ON s.customer_id = c.customer_id'
  when 9 then 'SELECT sum(value_usd) FROM cargo_item WHERE container_id = ' || n || ';'
  when 10 then 'SELECT event_id FROM SHIPMENT_EVENT limit  ' || n || '00 '
  when 11 then 'SELECT * FROM berth_' || n
  when 12 then 'SELECT eta FROM voyage_stop WHERE'
  when 13 then 'SELECT '';'' AS mark, "a;b" AS other FROM PORT WHERE port_name = ''it''''s; ' || n || ''''
  when 14 then 'SELECT * FROM port WHERE port_name = ''drop ' || n || ''''
  when 15 then 'VACUUM shipment'
  when 16 then 'select p.port_name from port p join zone_' || n || ' z on z.id = p.port_id join area_' || n
    || ' a on a.id = z.id'
  when 17 then 'SELECT * FROM (SELECT * FROM cargo_item LIMIT 5000' || n || ') x LIMIT 3'
  when 18 then 'SELECT * FROM customer WHERE company_name = ''' || props || ''';'
  else event_type || ' ' || n end as sql
from (select *, cast(event_id as varchar) as n from events)"""


def _sql_audit() -> str:
    known = ", ".join(f"'{name.upper()}'" for name in sorted(TABLES))
    valid = ", ".join(sorted(name.upper() for name in TABLES))
    read_only = "Only read-only SELECT queries are accepted."
    return f"""
select query_id, cast(len(errors) = 0 as integer) as is_valid,
       case when len(errors) = 0 then capped else '' end as sanitized_sql,
       array_to_string(errors, ' | ') as errors,
       case when len(security) > 0 then ''
         when lim = '' then 'LIMIT 1,000 appended automatically (no LIMIT clause found).'
         when cast(lim as bigint) > 1000 then 'LIMIT clamped from ' || format('{{:,}}', cast(lim as bigint))
           || ' to 1,000 (maximum rows allowed per query).'
         else '' end as warnings
from (
  select *, case when len(security) > 0 then security else list_concat(
      list_transform(list_sort(list_filter(refs, lambda x: not list_contains(ctes, x) and x not in ({known}))),
        lambda x: 'Unknown table referenced: ''' || x || '''. Valid tables: {valid}.'),
      case when open_end <> '' then
        ['SQL syntax / planning error: nothing follows ''' || open_end || '''.'] else [] end) end as errors
  from (
    select *, list_distinct(list_transform(
        regexp_extract_all(capped, '\\b(?:FROM|JOIN)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1, 'i'), lambda x: upper(x)))
        as refs,
      list_transform(regexp_extract_all(capped, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s+AS\\s*\\(', 1, 'i'),
        lambda x: upper(x)) as ctes,
      upper(regexp_extract(body, '\\b({OPEN_CLAUSES})\\z', 1, 'i')) as open_end
    from (
      select *, case when lim = '' then body || chr(10) || 'LIMIT 1000'
          when cast(lim as bigint) > 1000 then regexp_replace(body, '\\bLIMIT\\s+\\d+\\b', 'LIMIT 1000', 'gi')
          else body end as capped
      from (
        select query_id, work, body, regexp_extract(body, '\\bLIMIT\\s+(\\d+)\\b', 1, 'i') as lim,
          case when work = '' then ['SQL string is empty.'] else list_filter([
            case when contains(work, '--') then 'Line comments (''--'') are not permitted. '
              || 'The query must contain no comment syntax.' end,
            case when contains(work, '/*') or contains(work, '*/') then
              'Block comments (''/* … */'') are not permitted. '
              || 'The query must contain no comment syntax.' end,
            case when contains(regexp_replace(regexp_replace(work, ';\\z', ''),
                '''[^'']*(?:''|\\z)|"[^"]*(?:"|\\z)', '', 'g'), ';') then
              'Multiple SQL statements are not permitted (semicolon detected outside a string literal). '
              || 'Send one SELECT statement at a time.' end,
            case when blocked <> '' then
              'Forbidden keyword ''' || blocked || ''' is not permitted. {read_only}' end,
            case when first not in ('SELECT', 'WITH') then
              'Query must begin with SELECT or WITH, got ''' || first || '''. {read_only}' end
          ], lambda x: x is not null) end as security
        from (
          select query_id, work, rtrim(regexp_replace(work, ';+\\z', '')) as body,
                 upper(regexp_extract(work, '\\b({BLOCKED_WORDS})\\b', 1, 'i')) as blocked,
                 upper(regexp_extract(work, '\\A(\\S+)', 1)) as first
          from (select query_id, regexp_replace(sql, '\\A\\s+|\\s+\\z', '', 'g') as work from ({QUERY_LOG})))
      ))))"""


def _replies() -> str:
    trim = "regexp_replace({}, '\\A\\s+|\\s+\\z', '', 'g')"
    bare = r"(?:\A|[^\p{L}\p{N}_])((?:with|select)(?:[^\p{L}\p{N}_].*|\z))"
    return f"""
select conv_id, turn,
  case when tagged then regexp_replace(regexp_replace({trim.format("regexp_extract(t, '<sql>(.*?)</sql>', 1, 'si')")},
         '\\A```(?:sql)?\\s*', '', 'i'), '\\s*```\\z', '')
    when fenced then {trim.format("regexp_extract(t, '```(?:sql)?\\s*(.*?)```', 1, 'si')")}
    else {trim.format(f"regexp_extract(t, '{bare}', 1, 'si')")} end as sql,
  case when tagged then {trim.format("regexp_extract(t, '<explanation>(.*?)</explanation>', 1, 'si')")}
    when fenced then {trim.format("regexp_replace(t, '```.*?```', '', 'sg')")}
    when regexp_matches(t, '{bare}', 'si') then '' else {trim.format("t")} end as explanation
from (select conv_id, turn, t, regexp_matches(t, '<sql>.*?</sql>', 'si') as tagged,
             regexp_matches(t, '```.*?```', 'si') as fenced
  from (select conv_id, turn, case (conv_id + turn) % 6
      when 0 then '<sql> ' || query || ' </sql><explanation>' || text || '</explanation>'
      when 1 then text || chr(10) || '```sql' || chr(10) || query || chr(10) || '```' || chr(10) || text
      when 2 then '<SQL>```sql' || chr(10) || 'SELECT * FROM vessel;' || chr(10) || '```</SQL>' || text
      when 3 then text || ' ' || query
      when 4 then '<sql></sql>' || text
      else text end as t
    from (select *, 'SELECT bl_number FROM shipment WHERE shipment_id = ' || cast(conv_id + turn as varchar)
      as query from conversations)))"""


MARKED_PORTS = f"""
select port_id, port_name, is_transshipment, total_calls,
       8e0 + (total_calls - min(total_calls) over (partition by is_transshipment)) * 28e0
         / greatest(1, max(total_calls) over (partition by is_transshipment)
                       - min(total_calls) over (partition by is_transshipment)) as marker_size
from ({PORT_VOLUME})"""

TIMELINE = """
select bl_number, event_id, event_type, event_timestamp, un_locode, port_name, latitude, longitude, description,
       created_by
from shipment_event e join shipment using (shipment_id) left join port p on p.port_id = e.port_id"""

MILLIONS = "'$' || printf('%.1f', {}) || ' M'"

# Names of the freight views are in scope; ``oracle_sql`` puts them in front.
FREIGHT: dict[str, str] = {
    "k01_vessel_utilization": UTILIZATION,
    "k02_capacity_vs_booked_teu": CAPACITY,
    "k03_busiest_ports": BUSIEST,
    "k04_avg_delay_by_route": ROUTE_DELAY,
    "k05_leg_distances": LEGS,
    "k06_on_time_performance": PUNCTUALITY,
    "k07_delayed_voyages": DELAYED,
    "k08_avg_delay_by_port": PORT_DELAY,
    "k09_top_customers_by_value": CUSTOMERS,
    "k10_revenue_by_trade_lane": LANES,
    "k11_shipment_status_breakdown": STATUSES,
    "k12_reefer_by_type": REEFER_TYPES,
    "k13_reefer_summary": REEFERS,
    "k14_category_kpis": f"""
select category, kpi, measure, count(value) as n_values, min(value) as least, max(value) as greatest
from ({KPI_VALUES}) group by all""",
    "k15_all_kpis": KPI_VALUES,
    "k16_run_query": f"""
select strftime(departure_date, '%Y-%m') as month, status, count(*) as voyages,
       {_big("sum(cast(trunc((epoch_ms(arrival_date) + 210866760000000) / 86400000e0 - "
             "(epoch_ms(departure_date) + 210866760000000) / 86400000e0) as bigint))")} as days
from voyage where status <> 'Scheduled' group by 1, 2""",
    "d01_shipment_list": SHIPMENT_LIST,
    "d02_shipment_detail": """
select bl_number, s.status, incoterms, booking_date, total_weight_kg, total_value_usd, company_name, industry,
       voyage_number, departure_date, arrival_date, v.status as voyage_status, route_name,
       a.port_name as origin_port, a.un_locode as origin_locode, b.port_name as dest_port,
       b.un_locode as dest_locode
from shipment s join customer using (customer_id) join voyage v using (voyage_id) join route r using (route_id)
join port a on a.port_id = s.origin_port_id join port b on b.port_id = s.dest_port_id""",
    "d03_event_timeline": f"""
select bl_number, event_id, event_type, event_timestamp, port_name, description from ({TIMELINE})""",
    "d04_shipment_containers": f"""
select bl_number, container_number, container_type, is_reefer, temperature_c, tare_weight_kg, max_payload_kg,
       count(cargo_id) as cargo_items, {_round(_dsum("value_usd"), 0)} as cargo_value_usd
from container join shipment using (shipment_id) left join cargo_item using (container_id)
group by container_id, bl_number, container_number, container_type, is_reefer, temperature_c, tare_weight_kg,
         max_payload_kg""",
    "d05_port_volume": PORT_VOLUME,
    "d06_leg_segments": """
select route_name, service_name, leg_sequence, a.latitude as from_lat, a.longitude as from_lon,
       a.port_name as from_name, b.latitude as to_lat, b.longitude as to_lon, b.port_name as to_name, distance_nm
from route_leg join route using (route_id)
join port a on a.port_id = from_port_id join port b on b.port_id = to_port_id""",
    "d07_shipment_stops": """
select voyage_number, stop_sequence, eta, ata, delay_hours, port_name, un_locode, latitude, longitude
from voyage join voyage_stop vs using (voyage_id) join port p on p.port_id = vs.port_id
where voyage_id in (select voyage_id from shipment)""",
    "d08_shipment_meta": f"""
select bl_number, s.status, incoterms, total_value_usd, company_name, voyage_number, route_name
from shipment s join customer using (customer_id) join voyage v using (voyage_id) join route using (route_id)
where shipment_id in {HELD}""",
    "d01_shipment_page": f"""
select * from ({SHIPMENT_LIST}) where booking_date <= timestamp '1996-06-01 00:00:00'
order by booking_date desc, bl_number limit 100""",
    "d07_shipment_stops_single": """
select voyage_number, stop_sequence, eta, ata, delay_hours, port_name, un_locode, latitude, longitude
from voyage join voyage_stop vs using (voyage_id) join port p on p.port_id = vs.port_id
where voyage_id = (select voyage_id from shipment where bl_number = 'BL000000000007')""",
    "d08_shipment_meta_single": """
select bl_number, s.status, incoterms, total_value_usd, company_name, voyage_number, route_name
from shipment s join customer using (customer_id) join voyage v using (voyage_id) join route r using (route_id)
where bl_number = 'BL000000000007'""",
    "j01_in_transit_shipments": """
select bl_number, company_name, c.country_code as customer_country, vessel_name, vessel_type, incoterms,
       total_value_usd
from shipment s join customer c using (customer_id) join voyage using (voyage_id) join vessel using (vessel_id)
where s.status = 'In Transit'""",
    "j02_route_leg_audit": f"""
select route_id, route_name, service_name, transit_days, count(leg_id) as leg_count,
       {_big("sum(distance_nm)")} as total_distance_nm
from route left join route_leg using (route_id) group by route_id, route_name, service_name, transit_days""",
    "j03_shipment_manifest": """
select bl_number, company_name, vessel_name, a.un_locode as origin_locode, a.port_name as origin_port,
       b.un_locode as dest_locode, b.port_name as dest_port, incoterms, total_weight_kg, total_value_usd,
       v.status as voyage_status
from shipment s join customer using (customer_id) join voyage v using (voyage_id) join vessel using (vessel_id)
join port a on a.port_id = s.origin_port_id join port b on b.port_id = s.dest_port_id""",
    "j04_consecutive_legs": """
select route_name, x.leg_sequence as leg_num, f.port_name as departure_port, m.port_name as junction_port,
       l.port_name as arrival_port, x.distance_nm as leg1_nm, y.distance_nm as leg2_nm,
       x.distance_nm + y.distance_nm as combined_nm
from route_leg x join route_leg y on y.route_id = x.route_id and y.leg_sequence = x.leg_sequence + 1
join route r on r.route_id = x.route_id join port f on f.port_id = x.from_port_id
join port m on m.port_id = x.to_port_id join port l on l.port_id = y.to_port_id""",
    "j05_above_route_average": f"""
select bl_number, company_name, route_name, total_value_usd, status
from (select s.*, v.route_id, {_dsum("total_value_usd")} over (partition by v.route_id)
        / count(total_value_usd) over (partition by v.route_id) as mean_value
      from shipment s join voyage v using (voyage_id)) s
join customer using (customer_id) join route r on r.route_id = s.route_id
where total_value_usd > mean_value""".replace(
        f"{_dsum('total_value_usd')} over (partition by v.route_id)",
        f"cast({_sum('total_value_usd')} over (partition by v.route_id) as double)",
    ),
    "j06_voyages_with_customs_hold": """
select distinct vessel_name, imo_number, operator, voyage_number, vo.status as voyage_status
from vessel join voyage vo using (vessel_id)
where exists (select 1 from shipment s join shipment_event e using (shipment_id)
              where s.voyage_id = vo.voyage_id and e.event_type = 'Customs Hold')""",
    "w01_delay_rank_at_port": """
select port_name, voyage_number, eta, ata, delay_hours,
       rank() over (partition by vs.port_id order by delay_hours desc) as delay_rank_at_port
from voyage_stop vs join voyage using (voyage_id) join port p on p.port_id = vs.port_id
where delay_hours > 0""",
    "w02_revenue_rank_in_country": f"""
select country_code, company_name, {_dsum("total_value_usd")} as total_revenue_usd,
       dense_rank() over (partition by country_code order by {_sum("total_value_usd")} desc)
         as revenue_rank_in_country
from shipment join customer using (customer_id) group by customer_id, country_code, company_name""",
    "w03_booking_sequence": """
select company_name, bl_number, booking_date, total_value_usd,
       row_number() over (partition by customer_id order by booking_date, shipment_id) as booking_sequence
from shipment join customer using (customer_id)""",
    "w04_delay_change": """
select voyage_number, stop_sequence, port_name, delay_hours as current_delay_h,
       lag(delay_hours) over w as prev_stop_delay_h,
       delay_hours - lag(delay_hours, 1, 0e0) over w as delay_change_h
from voyage_stop vs join voyage using (voyage_id) join port p on p.port_id = vs.port_id
window w as (partition by voyage_id order by stop_sequence)""",
    "w05_next_leg": """
select route_name, leg_sequence, a.port_name as from_port, b.port_name as to_port, distance_nm,
       lead(distance_nm) over w as next_leg_nm, lead(b.port_name) over w as next_destination
from route_leg join route using (route_id)
join port a on a.port_id = from_port_id join port b on b.port_id = to_port_id
window w as (partition by route_id order by leg_sequence)""",
    "w06_year_to_date": f"""
select booking_year, booking_month, n as shipments_booked, cast(usd as double) as monthly_revenue_usd,
       {_big("sum(n) over w")} as ytd_shipment_count, cast(sum(usd) over w as double) as ytd_revenue_usd
from (select strftime(booking_date, '%Y') as booking_year, strftime(booking_date, '%m') as booking_month,
             count(*) as n, {_sum("total_value_usd")} as usd from shipment group by 1, 2)
window w as (partition by booking_year order by booking_month rows unbounded preceding)""",
    "a01_port_congestion": f"""
select un_locode, port_name, country_code, is_transshipment, count(stop_id) as total_vessel_calls,
       {_count("delay_hours > 0")} as delayed_calls, {_pct(_count("delay_hours > 0"), "count(stop_id)")} as pct_delayed,
       {_round("avg(delay_hours)", 2)} as avg_delay_hours, {_round("sum(delay_hours)", 2)} as total_delay_hours,
       {_round("(sum(delay_hours) / nullif(count(stop_id), 0))", 2)} as congestion_index
from port p left join voyage_stop vs on vs.port_id = p.port_id
group by p.port_id, un_locode, port_name, country_code, is_transshipment""",
    "a02_lane_punctuality": f"""
select a.country_code || ' -> ' || b.country_code as trade_lane, count(*) as shipments_measured,
       {_count("delay_hours = 0")} as on_time, {_pct(_count("delay_hours = 0"), "count(*)")} as otp_pct,
       {_round("avg(delay_hours)", 2)} as avg_final_delay_hours
from shipment s join (select voyage_id, delay_hours from voyage_stop
                      qualify row_number() over (partition by voyage_id order by stop_sequence desc) = 1)
  using (voyage_id)
join port a on a.port_id = s.origin_port_id join port b on b.port_id = s.dest_port_id
where s.status in ('Arrived', 'Delivered') group by a.country_code, b.country_code""",
    "a03_value_concentration": f"""
select company_name, industry, country_code, n as shipment_count, cast(usd as double) as customer_revenue_usd,
       {_pct("usd", "sum(usd) over ()", 2)} as pct_of_total,
       {_pct("sum(usd) over (order by usd desc, customer_id rows unbounded preceding)", "sum(usd) over ()", 2)}
         as cumulative_pct
from (select customer_id, company_name, industry, country_code, count(*) as n, {_sum("total_value_usd")} as usd
      from shipment join customer using (customer_id) group by 1, 2, 3, 4)""",
    "a04_voyage_load": f"""
select voyage_number, departure_date, status, vessel_name, vessel_type, gross_tonnage as capacity_kg,
       shipment_count, kg as loaded_weight_kg, {_pct("kg", "gross_tonnage")} as utilisation_pct,
       case when kg / nullif(gross_tonnage, 0) >= 0.9e0 then 'Full'
         when kg / nullif(gross_tonnage, 0) >= 0.6e0 then 'Moderate'
         when kg / nullif(gross_tonnage, 0) > 0 then 'Low' else 'Empty' end as load_band
from (select v.*, count(shipment_id) as shipment_count, {_dsum("total_weight_kg")} as kg
      from voyage v left join shipment s using (voyage_id) group by all) join vessel using (vessel_id)""",
    "a05_monthly_revenue": f"""
select month, n as new_shipments, cast(usd as double) as booked_revenue_usd,
       {_round("(cast(sum(usd) over (order by month rows 2 preceding) as double)"
               " / count(*) over (order by month rows 2 preceding))", 2)} as rolling_3m_avg_usd,
       cast(sum(usd) over (order by month rows unbounded preceding) as double) as cumulative_revenue_usd
from (select strftime(booking_date, '%Y-%m') as month, count(*) as n, {_sum("total_value_usd")} as usd
      from shipment where status <> 'Cancelled' group by 1)""",
    "a06_delay_by_vessel": f"""
select vessel_name, vessel_type, flag_state, operator, count(distinct voyage_id) as total_voyages,
       count(*) as total_port_calls, {_round("avg(delay_hours)", 2)} as avg_delay_hours,
       {_round("max(delay_hours)", 2)} as worst_delay_hours,
       {_round("sum(delay_hours)", 2)} as cumulative_delay_hours,
       dense_rank() over (order by avg(delay_hours) desc) as delay_rank
from voyage_stop join voyage using (voyage_id) join vessel using (vessel_id)
group by vessel_id, vessel_name, vessel_type, flag_state, operator""",
    "v01_row_counts": " union all ".join(
        f"select '{name.upper()}' as table_name, count(*) as row_count from {name}" for name in TABLES
    ),
    "v02_v18_reference_orphans": ORPHANS,
    "v19_fleet_roster": f"""
select vessel_name, operator, vessel_type, teu_capacity, flag_state, count(voyage_id) as total_voyages,
       {_count("status = 'Completed'")} as completed_voyages
from vessel left join voyage using (vessel_id)
group by vessel_id, vessel_name, operator, vessel_type, teu_capacity, flag_state""",
    "v20_route_map_summary": f"""
select route_name, service_name, transit_days, a.un_locode as origin_locode, a.port_name as origin_port,
       b.un_locode as dest_locode, b.port_name as dest_port, count(leg_id) as leg_count,
       {_big("sum(distance_nm)")} as total_distance_nm
from route join port a on a.port_id = origin_port_id join port b on b.port_id = dest_port_id
left join route_leg using (route_id) group by route_id, 1, 2, 3, 4, 5, 6, 7""",
    "v21_voyage_schedule": f"""
select voyage_number, vessel_name, route_name, status, departure_date, arrival_date, count(stop_id) as stop_count,
       {_round("avg(delay_hours)", 1)} as avg_delay_hours, {_round("max(delay_hours)", 1)} as max_delay_hours
from voyage join vessel using (vessel_id) join route using (route_id) left join voyage_stop using (voyage_id)
group by voyage_id, 1, 2, 3, 4, 5, 6 order by departure_date, voyage_id limit 20""",
    "v22_commercial_chain": f"""
select bl_number, company_name as customer, a.un_locode as origin, b.un_locode as destination, incoterms, status,
       count(distinct container_id) as containers, count(cargo_id) as cargo_lines,
       {_round(_dsum("weight_kg"), 0)} as total_cargo_kg, {_round(_dsum("value_usd"), 0)} as total_cargo_usd
from shipment s join customer using (customer_id) join port a on a.port_id = origin_port_id
join port b on b.port_id = dest_port_id
left join container using (shipment_id) left join cargo_item using (container_id)
group by shipment_id, 1, 2, 3, 4, 5, 6 order by total_cargo_usd desc nulls last, shipment_id limit 20""",
    "v23_longest_chain": f"""
select event_timestamp, event_type, un_locode as port, port_name, description, created_by from ({TIMELINE})
where bl_number = (select bl_number from shipment join shipment_event using (shipment_id)
                   group by bl_number order by count(*) desc, bl_number limit 1)""",
    "p01_marker_sizes": MARKED_PORTS,
    "p02_delay_series": f"""
with routes as ({ROUTE_DELAY})
select route_name, 'Avg delay (h)' as series, avg_delay_h as value from routes union all
select route_name, 'Max delay (h)', max_delay_h from routes union all
select route_name, 'OTP %', otp_pct from routes where otp_pct is not null""",
    "p03_punctuality_bands": f"""
with fleet as ({PUNCTUALITY})
select 'On time (≤ 4 h)' as band, on_time as stops from fleet union all
select 'Delayed (4–24 h)', greatest(0, delayed - severely_delayed) from fleet union all
select 'Severely delayed (> 24 h)', severely_delayed from fleet union all
select 'Pending', pending_stops from fleet""",
    "p04_voyage_status_series": f"""
with vessels as ({UTILIZATION})
select vessel_name, 'Completed' as state, completed as voyages from vessels union all
select vessel_name, 'Active', active from vessels union all
select vessel_name, 'Arrived', arrived from vessels union all
select vessel_name, 'Scheduled', scheduled from vessels""",
    "p05_top_customers": f"""
select company_name, industry, total_value_usd,
       (dense_rank() over (order by lowest, industry) - 1) % 10 as color_index
from (select *, min(total_value_usd) over (partition by industry) as lowest
      from (select company_name, industry, total_value_usd from ({CUSTOMERS})
            order by total_value_usd desc, company_name limit 10))""",
    "p06_lane_labels": f"""
select route_name || '<br>' || {MILLIONS.format(_round("(total_value_usd / 1e6)", 1))} as label, total_value_usd,
       shipment_count, customer_count, avg_value_usd, service_name from ({LANES})""",
    "p07_status_chart": f"""
select status, shipment_count, total_value_usd,
       case status when 'Booked' then '#bdc3c7' when 'Loaded' then '#2980b9' when 'In Transit' then '#e8673c'
         when 'Arrived' then '#27ae60' when 'Delivered' then '#27ae60' when 'Cancelled' then '#c0392b'
         else '#7f8c8d' end as color,
       {MILLIONS.format(_round("(total_value_usd / 1e6)", 1))} as label from ({STATUSES})""",
    "p08_event_pins": f"""
select bl_number, event_id, event_type, event_timestamp, port_name, latitude, longitude,
       (dense_rank() over (partition by bl_number order by first_at) - 1) % 10 as color_index
from (select *, first_value({{'at': event_timestamp, 'id': event_id}}) over (partition by bl_number, event_type
        order by event_timestamp, event_id) as first_at
      from ({TIMELINE}) where latitude is not null and longitude is not null)""",
    "p09_kpi_tiles": f"""
with lanes as ({LANES}), fleet as ({PUNCTUALITY})
select (select count(*) from voyage join vessel using (vessel_id) where status in ('In Transit', 'Departed'))
         as active_voyages,
       (select count(*) from voyage join vessel using (vessel_id) where status = 'Scheduled') as scheduled_voyages,
       (select count(*) from shipment) as total_shipments,
       (select count(*) from shipment where status = 'In Transit') as in_transit,
       otp_pct, avg_delay_h, severely_delayed,
       (select route_name from lanes order by total_value_usd desc, route_name limit 1) as top_lane,
       (select max(total_value_usd) from lanes) as top_lane_value_usd
from fleet""",
    "p10_insights": f"""
with lanes as ({LANES}), ports as ({BUSIEST}), routes as ({ROUTE_DELAY}), customers as ({CUSTOMERS})
(select 'busiest port' as insight, port_name as subject, un_locode as detail, cast(total_calls as double) as value
 from ports order by total_calls desc, un_locode limit 1) union all
(select 'worst route', route_name, null, avg_delay_h from routes order by avg_delay_h desc, route_name limit 1)
union all
(select 'top customer', company_name, industry, total_value_usd from customers
 order by total_value_usd desc, company_name limit 1) union all
(select 'trade lanes', null, null, cast(count(*) as double) from lanes having count(*) > 0) union all
(select 'booked revenue', null, null, cast(sum(cast(total_value_usd as decimal(38,2))) as double) from lanes
 having count(*) > 0) union all
(select 'severe delays', null, null, cast({_count(SEVERE)} as double) from voyage_stop
 having {_count(SEVERE)} > 0)""",
    "p11_filter_options": f"""
select distinct 'status' as "filter", status as value from ({SHIPMENT_LIST}) where status is not null union all
select distinct 'trade_lane', trade_lane from ({SHIPMENT_LIST}) where trade_lane is not null""",
    "p11_filtered_list": f"""
select * from ({SHIPMENT_LIST})
where status in ('Booked', 'In Transit', 'Loaded') and starts_with(bl_number, 'BL')""",
    "t01_load_typed": "select * from shipment_event",
    "t01_accepted_rows": """
select * from shipment_event where event_id % 13 <> 1 and event_id % 17 <> 2 and event_id % 19 <> 3""",
    "t01_rejected_rows": """
select case when event_id % 13 = 1 then 'E' else '' end || event_id as event_id,
       cast(shipment_id as varchar) as shipment_id,
       concat_ws('; ', case when event_id % 13 = 1 then 'event_id: not a bigint' end,
         case when event_id % 17 = 2 then 'event_type: missing' end,
         case when event_id % 19 = 3 then 'event_timestamp: not a timestamp_ntz' end) as reasons
from shipment_event where event_id % 13 = 1 or event_id % 17 = 2 or event_id % 19 = 3""",
    "t02_load_once": "select * from shipment",
    "t02_load_once_pruned": "select * from shipment",
    "t03_resolve_keys": "select voyage_number, vessel_id from voyage",
    "t04_constraint_audit": _constraint_rules(),
    "t04_constraint_audit_merged": _constraint_rules(),
    "t05_voyage_status": f"""
select voyage_id, voyage_number, status, expected as expected_status, cast(status = expected as integer) as agrees
from (select *, case when date_diff('second', timestamp '{AS_OF}', departure_date) > 0 then 'Scheduled'
        when date_diff('second', timestamp '{AS_OF}', departure_date) > -6 * 3600 then 'Departed'
        when date_diff('second', timestamp '{AS_OF}', arrival_date) > 0 then 'In Transit'
        when date_diff('second', timestamp '{AS_OF}', arrival_date) > -3 * 86400 then 'Arrived'
        else 'Completed' end as expected from voyage)""",
    "t05_voyage_status_stale": """
select voyage_id, voyage_number, status, expected as expected_status, cast(status = expected as integer) as agrees
from (select *, case when timestamp '1998-03-01 09:30:00' < departure_date then 'Scheduled'
        when timestamp '1998-03-01 09:30:00' - interval '6' hour < departure_date then 'Departed'
        when timestamp '1998-03-01 09:30:00' < arrival_date then 'In Transit'
        when timestamp '1998-03-01 09:30:00' - interval '3' day < arrival_date then 'Arrived'
        else 'Completed' end as expected from voyage)""",
    "t05_voyage_status_over_time": """
select seen_at, status, count(voyage_id) as voyages
from (select timestamp '1995-01-01 09:30:00' + n * interval '1' day as seen_at from range(2700) as r(n))
cross join (values ('Scheduled'), ('Departed'), ('In Transit'), ('Arrived'), ('Completed')) as s(status)
left join (select n, voyage_id,
             case when now < departure_date then 'Scheduled'
               when now - interval '6' hour < departure_date then 'Departed' when now < arrival_date then 'In Transit'
               when now - interval '3' day < arrival_date then 'Arrived' else 'Completed' end as seen
           from voyage cross join (select n, timestamp '1995-01-01 09:30:00' + n * interval '1' day as now
                                   from range(2700) as r(n))) v
  on v.seen = status and timestamp '1995-01-01 09:30:00' + v.n * interval '1' day = seen_at
group by seen_at, status""",
    "t06_event_chains": _event_chains(),
    "t07_check_digits": """
select container_id, container_number, digit as expected_digit,
       cast(right(container_number, 1) = cast(digit as varchar) as integer) as valid
from (select container_id, container_number, cast(list_sum(list_transform(
        range(1, length(container_number)), lambda i: ascii(substr(container_number, i, 1)) * i)) % 10 as bigint)
        as digit
      from container)""",
    "t09_guard_cases": """
select 'sibling' as text, 1 as accepted, cast(sum(port_id + 1) as bigint) as n from port
union all select 'shadowed', 1, count(*) from customer
union all select 'nested', 1, max(stop_id) from voyage_stop
union all select 'inner_first', 1, count(*) from voyage where voyage_id > 10
union all select 'subquery', 1, count(*) from shipment where voyage_id < (select max(voyage_id) from voyage)
union all select 'own_name', 0, null
union all select 'left_scope', 0, null
union all select 'later_name', 0, null""",
    "t09_guarded_query": """
select un_locode, n, worst
from (select port_id, count(*) as n, max(delay_hours) as worst from voyage_stop group by port_id)
join port using (port_id)""",
}

LONG_CONVERSATIONS = "select conv_id // 10 as conv_id, conv_id % 10 * 10000 + turn as turn, role, text from conversations"

TEXTS: dict[str, str] = {
    "t08_sql_audit": _sql_audit(),
    "t10_reply_extraction": _replies(),
    "t11_recent_messages": """
select conv_id, turn, role, text from conversations
qualify row_number() over (partition by conv_id order by turn desc) <= 20""",
    "t11_cleared": """
select conv_id, turn, role, text from conversations m
where not exists (select 1 from conversations r where r.conv_id = m.conv_id and r.role = 'system' and r.turn >= m.turn)""",
    "t11_recent_messages_long": f"""
select conv_id, turn, role, text from ({LONG_CONVERSATIONS})
qualify row_number() over (partition by conv_id order by turn desc) <= 20""",
    "t12_question_quota_long": f"""
select conv_id, n as question_count, greatest(0, 20 - n) as remaining, cast(n >= 20 as integer) as at_limit
from (select conv_id, count(*) filter (where role in ('assistant', 'model')) as n from ({LONG_CONVERSATIONS}) group by 1)""",
    "t12_question_quota": """
select conv_id, n as question_count, greatest(0, 20 - n) as remaining, cast(n >= 20 as integer) as at_limit
from (select conv_id, count(*) filter (where role in ('assistant', 'model')) as n from conversations group by 1)""",
}


# The tables with faults: what the names of the freight views stand for in the queries over them.
DAMAGED = """
bad_route as (select * replace (case when route_id % 7 = 3 then -1 else origin_port_id end as origin_port_id,
  case when route_id % 7 = 4 then -1 else dest_port_id end as dest_port_id) from route),
bad_route_leg as (select * replace (case when leg_id % 11 = 5 then -1 else route_id end as route_id,
  case when leg_id % 11 = 6 then -1 else from_port_id end as from_port_id,
  case when leg_id % 11 = 7 then -1 else to_port_id end as to_port_id) from route_leg),
bad_voyage as (select * replace (case when voyage_id % 101 = 1 then -1 else vessel_id end as vessel_id,
  case when voyage_id % 103 = 2 then -1 else route_id end as route_id,
  case when voyage_id % 67 = 5 then 'Lost' else status end as status,
  case when voyage_id % 53 = 6 then 'V0' else voyage_number end as voyage_number) from voyage),
bad_voyage_stop as (select * replace (case when stop_id % 107 = 3 then -1 else voyage_id end as voyage_id,
  case when stop_id % 109 = 4 then -1 else port_id end as port_id) from voyage_stop),
bad_shipment as (select * replace (case when shipment_id % 97 = 1 then -1 else customer_id end as customer_id,
  case when shipment_id % 97 = 2 then -1 else voyage_id end as voyage_id,
  case when shipment_id % 97 = 3 then -1 else origin_port_id end as origin_port_id,
  case when shipment_id % 97 = 4 then -1 else dest_port_id end as dest_port_id,
  case shipment_id % 61 when 5 then 'Loaded' when 6 then 'Lost' else status end as status,
  case when shipment_id % 59 <> 7 then bl_number end as bl_number) from shipment),
bad_container as (select * replace (case when container_id % 89 = 1 then -1 else shipment_id end as shipment_id)
  from container),
bad_cargo_item as (select * replace (case when cargo_id % 83 = 1 then -1 else container_id end as container_id,
  case when cargo_id % 71 = 8 then cargo_id - 1 else cargo_id end as cargo_id) from cargo_item),
bad_shipment_event as (select * replace (
  case when event_id % 5 = 0 then 1 when event_id % 79 = 1 then -1 else shipment_id end as shipment_id,
  case when event_id % 79 = 2 then -1 else port_id end as port_id) from shipment_event)"""
FAULTY = "route route_leg voyage voyage_stop shipment container cargo_item shipment_event".split()
ON_DAMAGED = (
    "v02_v18_reference_orphans",
    "v23_longest_chain",
    "t04_constraint_audit",
    "t04_constraint_audit_merged",
    "t06_event_chains",
)

# Registered a second time for one bill of lading.
BY_BL = ("d02_shipment_detail", "d03_event_timeline", "d04_shipment_containers")

# Registered a second time with every group cut; the result must be the same.
SPLIT = (
    "w01_delay_rank_at_port",
    "w02_revenue_rank_in_country",
    "w03_booking_sequence",
    "w04_delay_change",
    "a03_value_concentration",
)


def oracle_sql() -> dict[str, str]:
    found = {name: f"with {VIEWS}\nselect * from ({sql})" for name, sql in FREIGHT.items()}
    found |= {
        f"{name}_single": f"select * from ({found[name]}) where bl_number = 'BL000000000007'" for name in BY_BL
    }
    split = {f"{name}_split": found[name] for name in SPLIT}
    named = ", ".join(f"{name} as (select * from bad_{name})" for name in FAULTY)
    damaged = {
        f"{name}_damaged": f"with {VIEWS},{DAMAGED}\nselect * from (with {named} select * from ({FREIGHT[name]}))"
        for name in ON_DAMAGED
    }
    return {**found, **split, **damaged, **TEXTS}
