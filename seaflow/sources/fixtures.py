"""The freight model as views over the TPC-H-like Parquet tables used for tests and benchmarks.

``FIXTURES.md`` section 3 defines every view; ``seaflow.plans.oracles`` states the same definitions in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from seaflow.functions import spread
from seaflow.functions.measures import totals, voyage_status
from seaflow.sources.schema import CONTAINER_TYPES, EVENT_TYPES, INCOTERMS, TABLES
from seaflow.sources.tables import FreightTables

AS_OF = "2001-06-17 12:00:00"

# Columns of the source tables, declared so that opening a table needs no look into its files.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> str:
    return f"cast('{AS_OF}' as timestamp_ntz)"


def freight(spark: SparkSession, sf_dir: str) -> FreightTables:
    """The eleven freight tables derived from the source tables in ``sf_dir``."""
    views = _Views(spark, sf_dir)
    return FreightTables(spark, {name: getattr(views, name) for name in TABLES})


# What is wrong in the damaged tables: broken references, a key and a number that repeat, values outside their domain,
# missing values, statuses that don't go together, and one shipment with a fifth of all events.
DAMAGE = {
    "route": {
        "origin_port_id": "if(route_id % 7 = 3, -1, origin_port_id)",
        "dest_port_id": "if(route_id % 7 = 4, -1, dest_port_id)",
    },
    "route_leg": {
        "route_id": "if(leg_id % 11 = 5, -1, route_id)",
        "from_port_id": "if(leg_id % 11 = 6, -1, from_port_id)",
        "to_port_id": "if(leg_id % 11 = 7, -1, to_port_id)",
    },
    "voyage": {
        "vessel_id": "if(voyage_id % 101 = 1, -1, vessel_id)",
        "route_id": "if(voyage_id % 103 = 2, -1, route_id)",
        "status": "if(voyage_id % 67 = 5, 'Lost', status)",
        "voyage_number": "if(voyage_id % 53 = 6, 'V0', voyage_number)",
    },
    "voyage_stop": {
        "voyage_id": "if(stop_id % 107 = 3, -1, voyage_id)",
        "port_id": "if(stop_id % 109 = 4, -1, port_id)",
    },
    "shipment": {
        "customer_id": "if(shipment_id % 97 = 1, -1, customer_id)",
        "voyage_id": "if(shipment_id % 97 = 2, -1, voyage_id)",
        "origin_port_id": "if(shipment_id % 97 = 3, -1, origin_port_id)",
        "dest_port_id": "if(shipment_id % 97 = 4, -1, dest_port_id)",
        "status": "if(shipment_id % 61 = 5, 'Loaded', if(shipment_id % 61 = 6, 'Lost', status))",
        "bl_number": "if(shipment_id % 59 = 7, null, bl_number)",
    },
    "container": {"shipment_id": "if(container_id % 89 = 1, -1, shipment_id)"},
    "cargo_item": {
        "container_id": "if(cargo_id % 83 = 1, -1, container_id)",
        "cargo_id": "if(cargo_id % 71 = 8, cargo_id - 1, cargo_id)",
    },
    "shipment_event": {
        "shipment_id": "if(event_id % 5 = 0, 1, if(event_id % 79 = 1, -1, shipment_id))",
        "port_id": "if(event_id % 79 = 2, -1, port_id)",
    },
}


def damaged(t: FreightTables) -> FreightTables:
    """The tables with faults of every kind that the audits look for."""
    frames = {
        name: t.table(name).selectExpr(*[f"{DAMAGE.get(name, {}).get(c, c)} as {c}" for c in TABLES[name].columns])
        for name in t.names()
    }
    return FreightTables(t.spark, frames)


def long_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten conversations made one: far more messages and answers than the window and the quota."""
    return source(spark, sf_dir, "conversations").selectExpr(
        "conv_id div 10 as conv_id", "conv_id % 10 * 10000 + turn as turn", "role", "text"
    )


def _one_of(number: str, names: tuple[str, ...]) -> str:
    """The name at position ``number`` (0-based)."""
    listed = ", ".join(f"'{name}'" for name in names)
    return f"array({listed})[cast({number} as int)]"


def _typed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """The columns of table ``name``, in declared order, cast to their declared type."""
    fields = TABLES[name].schema.fields
    return df.selectExpr(
        *[f"cast({c} as {f.dataType.simpleString()}) as {f.name}" for c, f in zip(columns, fields, strict=True)]
    )


class _Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return source(self.spark, self.sf_dir, name)

    # Row counts that spread foreign keys over the rows of another table; answered from Parquet footers.
    @cached_property
    def _suppliers(self) -> int:
        return self._read("supplier").count()

    @cached_property
    def _parts(self) -> int:
        return self._read("part").count()

    @cached_property
    def _orders(self) -> int:
        return self._read("orders").count()

    def port(self) -> DataFrame:
        return _typed(
            self._read("nation").join(self._read("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"),
            "port",
            "n_nationkey",
            "upper(substr(r_name, 1, 2)) || lpad(cast(n_nationkey as string), 3, '0')",
            "n_name",
            "upper(substr(r_name, 1, 2))",
            "(n_nationkey * 37) % 181 - 90",
            "(n_nationkey * 53) % 361 - 180",
            "'UTC'",
            "if(n_nationkey % 4 = 0, 1, 0)",
        )

    def vessel(self) -> DataFrame:
        return _typed(
            self._read("supplier").join(
                self._read("nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey"
            ),
            "vessel",
            "s_suppkey",
            "'IMO' || lpad(cast(s_suppkey as string), 12, '0')",
            "s_name",
            "case s_suppkey % 8 when 5 then 'Bulk Carrier' when 6 then 'Tanker' when 7 then 'RoRo' "
            "else 'Container' end",
            "n_name",
            "60000 + (s_suppkey * 7919) % 140000",
            "case when s_suppkey % 8 < 5 then 5 + (s_suppkey * 613) % 160 end",
            "2000 + s_suppkey % 20",
            "'Operator ' || s_nationkey",
        )

    def route(self) -> DataFrame:
        return _typed(
            self._read("nation"),
            "route",
            "n_nationkey",
            "'Lane ' || n_name",
            "n_nationkey",
            "(n_nationkey + 2 * (1 + n_nationkey % 3)) % 25",
            "'Service ' || n_regionkey",
            "7 + (n_nationkey * 5) % 29",
        )

    def route_leg(self) -> DataFrame:
        legs = self._read("nation").filter("n_nationkey <> 24")
        return _typed(
            legs.selectExpr("n_nationkey", "explode(sequence(1, 1 + n_nationkey % 3)) as leg"),
            "route_leg",
            "n_nationkey * 10 + leg",
            "n_nationkey",
            "leg",
            "(n_nationkey + 2 * (leg - 1)) % 25",
            "(n_nationkey + 2 * leg) % 25",
            "200 + (n_nationkey * 997 + leg * 613) % 9000",
            "(n_nationkey + leg) % 14",
        )

    def voyage(self) -> DataFrame:
        departure = (
            "cast('1995-01-01 00:00:00' as timestamp_ntz) + make_dt_interval("
            "cast((p_partkey * 37) % 2400 as int), cast(4 + p_partkey % 18 as int)) as departure"
        )
        arrival = "departure + make_dt_interval(cast(7 + (p_partkey % 23 * 5) % 29 as int)) as arrival"
        return _typed(
            self._read("part").selectExpr("p_partkey", departure).selectExpr("*", arrival),
            "voyage",
            "p_partkey",
            "'V' || lpad(cast(p_partkey as string), 12, '0')",
            f"p_partkey % {self._suppliers - 1}",
            "p_partkey % 23",
            "departure",
            "arrival",
            voyage_status("departure", "arrival", as_of()),
        )

    def voyage_stop(self) -> DataFrame:
        stops = spread.numbered(
            self._read("lineitem"),
            keys=["l_partkey"],
            order=[
                "l_orderkey",
                "l_linenumber",
                "l_suppkey",
                "l_shipdate",
                "l_quantity",
                "l_extendedprice",
                "l_tax",
            ],
            levels={"_block": spread.block("l_orderkey")},
            name="stop",
        ).selectExpr(
            "*",
            "if(l_quantity <= 20, 0e0, (l_quantity - 20) * 1.25e0) as delay",
            "not (l_linestatus = 'O' and l_returnflag = 'N') as reached",
        )
        late_by = "make_dt_interval(0, 0, cast(delay * 60 as int))"
        return _typed(
            stops,
            "voyage_stop",
            "l_partkey * 1000000000 + stop",
            "l_partkey",
            "l_orderkey % 24",
            "stop",
            "l_shipdate",
            f"case when reached then l_shipdate + {late_by} end",
            "l_shipdate + interval 8 hours",
            f"case when reached then l_shipdate + interval 8 hours + {late_by} end",
            "delay",
        )

    def customer(self) -> DataFrame:
        return _typed(
            self._read("customer").join(
                self._read("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"
            ),
            "customer",
            "c_custkey",
            "c_name",
            "n_name",
            "c_mktsegment",
            "c_name || '@example.com'",
            "c_acctbal",
            "1",
        )

    def shipment(self) -> DataFrame:
        voyage = f"(o_orderkey % {self._parts - 10})"
        return _typed(
            self._read("orders").selectExpr("*", f"{voyage} as voyage", f"{voyage} % 23 as route"),
            "shipment",
            "o_orderkey",
            "'BL' || lpad(cast(o_orderkey as string), 12, '0')",
            "o_custkey",
            "voyage",
            "route",
            "(route + 2 * (1 + route % 3)) % 25",
            _one_of("o_orderkey % 11", INCOTERMS),
            "case when o_orderstatus = 'O' and o_orderpriority = '5-LOW' then 'Cancelled' "
            "when o_orderstatus = 'O' then 'Booked' "
            "when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 'Loaded' "
            "when o_orderstatus = 'P' then 'In Transit' "
            "when o_orderpriority = '1-URGENT' then 'Arrived' else 'Delivered' end",
            "o_orderdate",
            "5000 + (o_orderkey * 7919) % 20000",
            "o_totalprice",
        )

    def container(self) -> DataFrame:
        lines = self._read("lineitem").filter("l_orderkey % 10 <> 9")
        boxes = totals(lines, ["l_orderkey", "l_linenumber"], "min(l_partkey) as part").selectExpr(
            "l_orderkey",
            "l_orderkey * 10 + l_linenumber as key",
            "part",
            f"{_one_of('part % 7', CONTAINER_TYPES)} as kind",
        )
        return _typed(
            boxes,
            "container",
            "key",
            "'MSCU' || lpad(cast(key as string), 14, '0')",
            "l_orderkey",
            "kind",
            "2200 + (part % 7) * 250",
            "21000 + (part % 7) * 900",
            "if(kind like '%RF', 1, 0)",
            "case when kind like '%RF' then part % 30 - 25 end",
            "'SL' || (100000 + part % 900000)",
        )

    def cargo_item(self) -> DataFrame:
        lines = spread.numbered(
            self._read("lineitem").filter("l_orderkey % 10 <> 9 and l_linenumber <> 7"),
            keys=["l_orderkey", "l_linenumber"],
            order=["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_tax"],
            levels={"_block": spread.block("l_partkey")},
            name="item",
        ).join(self._read("part").selectExpr("p_partkey as l_partkey", "p_name"), "l_partkey")
        return _typed(
            lines,
            "cargo_item",
            "(l_orderkey * 10 + l_linenumber) * 1000000 + item",
            "l_orderkey * 10 + l_linenumber",
            "lpad(cast(l_partkey as string), 6, '0')",
            "p_name",
            "l_quantity",
            "'units'",
            "l_quantity * 2.5e0",
            "l_extendedprice",
        )

    def shipment_event(self) -> DataFrame:
        return _typed(
            self._read("events"),
            "shipment_event",
            "event_id",
            f"(event_id * 7) % {self._orders}",
            _one_of("(event_id * 5 + user_id) % 12", EVENT_TYPES),
            "ts",
            "case when event_id % 10 <> 0 then user_id % 25 end",
            "event_type || ' ' || event_id",
            "'SYSTEM'",
        )


# -- texts --------------------------------------------------------------------


# One SQL text per event, good and bad in turn, with values of the event in it; read by position.
_QUERY_TEXTS = (
    "'DELETE FROM shipment WHERE shipment_id = ' || event_id",
    "'SELECT eta FROM voyage_stop -- note ' || event_id",
    "'SELECT /* ' || event_id || ' */ route_name FROM route'",
    "'SELECT ' || event_id || '; DROP VIEW route'",
    "'describe route'",
    r"'  \n\t '",
    "'select route_name, service_name from route where route_id = ' || event_id",
    "'WITH legs AS (SELECT route_id FROM route_leg) SELECT * FROM legs LIMIT ' || event_id",
    "'SELECT c.company_name, s.bl_number FROM customer c JOIN shipment s ON s.customer_id = c.customer_id'",
    "'SELECT sum(value_usd) FROM cargo_item WHERE container_id = ' || event_id || ';'",
    "'SELECT event_id FROM SHIPMENT_EVENT limit  ' || event_id || '00 '",
    "'SELECT * FROM berth_' || event_id",
    "'SELECT eta FROM voyage_stop WHERE'",
    r"""'SELECT \';\' AS mark, "a;b" AS other FROM PORT WHERE port_name = \'it\'\'s; ' || event_id || '\''""",
    r"'SELECT * FROM port WHERE port_name = \'drop ' || event_id || '\''",
    "'VACUUM shipment'",
    "'select p.port_name from port p join zone_' || event_id || ' z on z.id = p.port_id join area_' || event_id "
    "|| ' a on a.id = z.id'",
    "'SELECT * FROM (SELECT * FROM cargo_item LIMIT 5000' || event_id || ') x LIMIT 3'",
    r"'SELECT * FROM customer WHERE company_name = \'' || props || '\';'",
    "event_type || ' ' || event_id",
)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL texts to audit."""
    cases = " ".join(f"when {position} then {text}" for position, text in enumerate(_QUERY_TEXTS))
    return source(spark, sf_dir, "events").selectExpr(
        "event_id as query_id", f"case event_id % {len(_QUERY_TEXTS)} {cases} end as sql"
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts put into each form a reply may take."""
    query = "'SELECT bl_number FROM shipment WHERE shipment_id = ' || (conv_id + turn)"
    return source(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "role",
        f"""case (conv_id + turn) % 6
            when 0 then '<sql> ' || {query} || ' </sql><explanation>' || text || '</explanation>'
            when 1 then text || '\\n```sql\\n' || {query} || '\\n```\\n' || text
            when 2 then '<SQL>```sql\\nSELECT * FROM vessel;\\n```</SQL>' || text
            when 3 then text || ' ' || {query}
            when 4 then '<sql></sql>' || text
            else text end as text""",
    )
