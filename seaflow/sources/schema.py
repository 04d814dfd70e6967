"""The freight model: eleven tables with keys, references, domains and defaults.

Spark enforces none of the constraints, so they are kept as data; the audits in
``seaflow.operators.quality`` turn them into checks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values of the model ---------------------------------------------------

VESSEL_TYPES = ("Container", "Bulk Carrier", "Tanker", "RoRo")
VOYAGE_STATUSES = ("Scheduled", "Departed", "In Transit", "Arrived", "Completed")
SHIPMENT_STATUSES = ("Booked", "Loaded", "In Transit", "Arrived", "Delivered", "Cancelled")
INCOTERMS = ("EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAP", "DPU", "DDP")
CONTAINER_TYPES = ("20GP", "40GP", "40HC", "20RF", "40RF", "20OT", "40OT")
EVENT_TYPES = (
    "Booking Confirmed",
    "Documents Received",
    "Gate In",
    "Loaded on Vessel",
    "Vessel Departed",
    "Port Arrival",
    "Customs Hold",
    "Customs Cleared",
    "Gate Out",
    "Delivered",
    "Exception",
    "Cancelled",
)
FLAG = (0, 1)

# Shipment statuses that are consistent with the status of the carrying voyage.
SHIPMENT_STATUS_OF_VOYAGE = {
    "Scheduled": ("Booked",),
    "Departed": ("Loaded", "In Transit"),
    "In Transit": ("In Transit",),
    "Arrived": ("Arrived", "Delivered"),
    "Completed": ("Delivered",),
}

# Ordered tracking events a shipment has passed through, by shipment status.
EVENT_CHAINS = {
    "Booked": ("Booking Confirmed",),
    "Loaded": ("Booking Confirmed", "Documents Received", "Gate In", "Loaded on Vessel"),
    "In Transit": (
        "Booking Confirmed",
        "Documents Received",
        "Gate In",
        "Loaded on Vessel",
        "Vessel Departed",
    ),
    "Arrived": (
        "Booking Confirmed",
        "Documents Received",
        "Gate In",
        "Loaded on Vessel",
        "Vessel Departed",
        "Port Arrival",
        "Customs Cleared",
        "Gate Out",
    ),
    "Delivered": (
        "Booking Confirmed",
        "Documents Received",
        "Gate In",
        "Loaded on Vessel",
        "Vessel Departed",
        "Port Arrival",
        "Customs Cleared",
        "Gate Out",
        "Delivered",
    ),
    "Cancelled": ("Booking Confirmed", "Cancelled"),
}
OPTIONAL_EVENTS = ("Customs Hold",)


@dataclass(frozen=True)
class TableSpec:
    """One table: typed columns plus the constraints declared on it."""

    name: str
    schema: T.StructType
    key: str
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, str] = field(default_factory=dict)
    domains: dict[str, tuple] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    # Columns a stored table is ordered by: those it is looked up or joined by, ending in unique ones.
    layout: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "ts": T.TimestampNTZType(),
}


def _struct(text: str) -> T.StructType:
    """``name type`` pairs; a ``?`` after the type marks a nullable column."""
    fields = []
    for item in text.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


_SPECS = (
    TableSpec(
        "vessel",
        _struct(
            "vessel_id long, imo_number string, vessel_name string, vessel_type string, flag_state string,"
            "gross_tonnage long, teu_capacity long?, year_built int, operator string"
        ),
        "vessel_id",
        unique=(("imo_number",),),
        domains={"vessel_type": VESSEL_TYPES},
    ),
    TableSpec(
        "port",
        _struct(
            "port_id long, un_locode string, port_name string, country_code string, latitude double,"
            "longitude double, timezone string, is_transshipment int"
        ),
        "port_id",
        unique=(("un_locode",),),
        domains={"is_transshipment": FLAG},
        defaults={"is_transshipment": 0},
    ),
    TableSpec(
        "route",
        _struct(
            "route_id long, route_name string, origin_port_id long, dest_port_id long, service_name string,"
            "transit_days int"
        ),
        "route_id",
        references={"origin_port_id": "port", "dest_port_id": "port"},
    ),
    TableSpec(
        "route_leg",
        _struct(
            "leg_id long, route_id long, leg_sequence int, from_port_id long, to_port_id long,"
            "distance_nm int, typical_days int"
        ),
        "leg_id",
        unique=(("route_id", "leg_sequence"),),
        references={"route_id": "route", "from_port_id": "port", "to_port_id": "port"},
    ),
    TableSpec(
        "voyage",
        _struct(
            "voyage_id long, voyage_number string, vessel_id long, route_id long, departure_date ts,"
            "arrival_date ts, status string"
        ),
        "voyage_id",
        unique=(("voyage_number",),),
        references={"vessel_id": "vessel", "route_id": "route"},
        domains={"status": VOYAGE_STATUSES},
        layout=("voyage_id",),
    ),
    TableSpec(
        "voyage_stop",
        _struct(
            "stop_id long, voyage_id long, port_id long, stop_sequence int, eta ts, ata ts?, etd ts, atd ts?,"
            "delay_hours double"
        ),
        "stop_id",
        unique=(("voyage_id", "stop_sequence"),),
        references={"voyage_id": "voyage", "port_id": "port"},
        defaults={"delay_hours": 0.0},
        layout=("voyage_id", "stop_sequence", "stop_id"),
    ),
    TableSpec(
        "customer",
        _struct(
            "customer_id long, company_name string, country_code string, industry string,"
            "contact_email string, credit_limit double, is_active int"
        ),
        "customer_id",
        domains={"is_active": FLAG},
        defaults={"is_active": 1},
        layout=("customer_id",),
    ),
    TableSpec(
        "shipment",
        _struct(
            "shipment_id long, bl_number string, customer_id long, voyage_id long, origin_port_id long,"
            "dest_port_id long, incoterms string, status string, booking_date ts, total_weight_kg double,"
            "total_value_usd double"
        ),
        "shipment_id",
        unique=(("bl_number",),),
        references={
            "customer_id": "customer",
            "voyage_id": "voyage",
            "origin_port_id": "port",
            "dest_port_id": "port",
        },
        domains={"incoterms": INCOTERMS, "status": SHIPMENT_STATUSES},
        layout=("bl_number", "shipment_id"),
    ),
    TableSpec(
        "container",
        _struct(
            "container_id long, container_number string, shipment_id long, container_type string,"
            "tare_weight_kg double, max_payload_kg double, is_reefer int, temperature_c double?,"
            "seal_number string"
        ),
        "container_id",
        unique=(("container_number",),),
        references={"shipment_id": "shipment"},
        domains={"container_type": CONTAINER_TYPES, "is_reefer": FLAG},
        defaults={"is_reefer": 0},
        layout=("shipment_id", "container_id"),
    ),
    TableSpec(
        "cargo_item",
        _struct(
            "cargo_id long, container_id long, hs_code string, description string, quantity int, unit string,"
            "weight_kg double, value_usd double"
        ),
        "cargo_id",
        references={"container_id": "container"},
        layout=("container_id", "cargo_id"),
    ),
    TableSpec(
        "shipment_event",
        _struct(
            "event_id long, shipment_id long, event_type string, event_timestamp ts, port_id long?,"
            "description string?, created_by string"
        ),
        "event_id",
        references={"shipment_id": "shipment", "port_id": "port"},
        domains={"event_type": EVENT_TYPES},
        defaults={"created_by": "SYSTEM"},
        layout=("shipment_id", "event_timestamp", "event_id"),
    ),
)

TABLES: dict[str, TableSpec] = {spec.name: spec for spec in _SPECS}
