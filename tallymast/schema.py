"""Canonical row layouts.  Readers produce these, so operators need no column guards."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _layout(text: str) -> T.StructType:
    """From ``name type, name type``; needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(","))])


CDR_RAW = _layout(
    "a_party string, b_party string, date string, time string, duration string, call_type string, first_cell string, "
    "last_cell string, imei string, imsi string, address string, lat string, lon string")
CDR = _layout(
    "subject string, event_id bigint, datetime timestamp, a_party string, b_party string, duration_seconds bigint, "
    "call_type string, first_cell string, last_cell string, address string, imei string, imsi string, lat double, lon double, "
    "is_provider_message boolean, hour int, day_of_week string, has_location boolean, source_file string")
IPDR = _layout(
    "subject string, event_id bigint, subscriber_id string, subscriber_id_clean string, imei string, imsi string, "
    "start_time timestamp, end_time timestamp, source_ip string, destination_ip string, source_port bigint, "
    "destination_port bigint, protocol string, data_volume_up double, data_volume_down double, app_protocol string, "
    "session_duration double, source_file string")
TOWER = _layout(
    "dump_id string, event_id bigint, timestamp timestamp, mobile_number string, imei string, imsi string, tower_id string, "
    "lat double, long double, duration double, signal_strength double, b_party string, call_type string, source_file string")
TOWER_DIM = _layout(
    "tower_id string, lat double, long double, address string, area string, city string, state string, coverage_radius double")
