"""Explicit schemas of the inputs; nothing is inferred in production paths."""

from __future__ import annotations

TELEMETRY = "datetime timestamp_ntz, machineID bigint, volt double, rotate double, pressure double, vibration double"
ERRORS = "datetime timestamp_ntz, machineID bigint, errorID string"
MAINT = "datetime timestamp_ntz, machineID bigint, comp string"
FAILURES = "datetime timestamp_ntz, machineID bigint, failure string"
MACHINES = "machineID bigint, model string, age int"

MACHINE_TABLE = """machine_id int not null, machine_code string not null, machine_type string not null, location string,
    image_url string, status string, created_at timestamp"""
COMPONENT_TABLE = "comp_id int not null, machine_id int, comp_code string not null, comp_name string not null, baseline_lifespan_days int"
TELEMETRY_STREAM = "time timestamp not null, machine_id int, sensor_payload string not null"
PREDICTIONS = """time timestamp not null, machine_id int, comp_id int, risk_probability double not null, shap_reasons string,
    is_verified_true boolean"""
TICKETS = """ticket_id int not null, machine_id int, comp_id int, created_at timestamp, resolved_at timestamp, status string,
    resolution_notes string"""
LIVE_METRICS = "metric_id int not null, machine_id int, load_percentage double, operation_level int, updated_at timestamp"

# Fields of the telemetry payload.
PAYLOAD = """volt double, rotate double, pressure double, vibration double, original_datetime string,
    original_machine_id bigint"""
