"""Call, session and tower views derived from the ``events`` table.

Every view is described once and rendered for Spark (a lazy DataFrame) and for a plain SQL
engine (a common table expression), so both sides of a check read the same rows.
The *dense* views squeeze thirty days into one, so that five-minute windows hold several
parties; the *part* views know some parties under another number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import configure

BASE_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC

SPARK = {
    "K": "CAST(get_json_object(props,'$.k') AS BIGINT)",
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
    "TS": "timestamp_micros",
    "DIV": "div",
    "STR": "STRING",
    "PORT": "element_at(array(443,5222,8443,3478,19302,1194,500,9001,9050,80,6881,45001), CAST(k%12+1 AS INT))",
    "DAY": "date_format(timestamp_micros(us), 'yyyy-MM-dd')",
    "CLOCK": "date_format(timestamp_micros(us), 'HH:mm:ss')",
    "CHR": "chr",
}
PLAIN = {
    "K": "CAST(json_extract_string(props,'$.k') AS BIGINT)",
    "US": "epoch_us(ts)",
    "TS": "make_timestamp",
    "DIV": "//",
    "STR": "VARCHAR",
    "PORT": "list_extract([443,5222,8443,3478,19302,1194,500,9001,9050,80,6881,45001], k%12+1)",
    "DAY": "strftime(make_timestamp(us), '%Y-%m-%d')",
    "CLOCK": "strftime(make_timestamp(us), '%H:%M:%S')",
    "CHR": "chr",
}

_CDR = """a_party AS subject; {{TS}}({t}) AS datetime; event_id; a_party; b_party; duration_seconds; call_type;
 imei; imsi; first_cell; last_cell; lat; lon; is_provider_message; {t} AS us"""
_TOWER = """event_id; a_party AS mobile_number; {{TS}}({t}) AS timestamp; first_cell AS tower_id;
 duration_seconds AS duration;
 CASE WHEN event_id % 2 = 0 AND ((user_id % 13 = 0 AND us < 1705363200000000)
   OR (user_id % 13 = 1 AND us >= 1705363200000000))
   THEN CAST(351000000000000 + user_id - user_id % 13 AS {{STR}}) ELSE imei END AS imei;
 imsi; lat; lon; {t} AS us; 'D1' AS dump_id"""
_IPDR = """event_id; CAST(9000000000 + user_id AS {{STR}}) AS subject;
 concat('+91', CAST(9000000000 + user_id AS {{STR}})) AS subscriber_id;
 {{TS}}({t}) AS start_time; {{TS}}({t} + CAST(floor(value * {f}) AS BIGINT) * 1000000) AS end_time;
 CAST({{PORT}} AS BIGINT) AS destination_port; CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol;
 CAST(floor(value * 200000) AS BIGINT) AS data_volume_up;
 CAST(floor(value * 500000) AS BIGINT) % 20000000 AS data_volume_down;
 {t} AS us; {t} + CAST(floor(value * {f}) AS BIGINT) * 1000000 AS end_us"""

# name -> (source, expressions separated by ';' or '*', filter, distinct)
VIEWS = {
    "ev": ("events", """event_id; user_id; event_type; value; {K} AS k; {US} AS us;
 1704067200000000 + ({US} - 1704067200000000) {DIV} 30 AS dus""", None, False),
    "cdr_both": ("ev", """event_id; user_id; us; dus; CAST(9000000000 + user_id AS {STR}) AS a_party;
 CASE WHEN k >= 95 THEN concat('AD-SVC', CAST(k AS {STR}))
   WHEN user_id % 6 = 3 THEN CAST(9000000000 + user_id + 1 + k % 3 AS {STR})
   ELSE CAST(9000000000 + k AS {STR}) END AS b_party;
 CAST(floor(value) AS BIGINT) AS duration_seconds;
 CASE WHEN user_id % 10 = 7 THEN CASE WHEN event_id % 2 = 0 THEN 'CALL-OUT' ELSE 'CALL-IN' END
   WHEN event_type IN ('click','error') THEN 'CALL-OUT' WHEN event_type = 'view' THEN 'CALL-IN'
   WHEN event_type = 'purchase' THEN 'SMS-OUT' ELSE 'SMS-IN' END AS call_type;
 CAST(350000000000000 + user_id * 10 + CASE user_id % 5 WHEN 0 THEN event_id % 3 WHEN 1 THEN event_id % 2 ELSE 0 END AS {STR}) AS imei;
 CAST(404000000000000 + user_id * 10 + CASE WHEN user_id % 7 = 0 THEN event_id % 2 ELSE 0 END AS {STR}) AS imsi;
 concat('T', CAST(k % 20 AS {STR})) AS first_cell;
 concat('T', CAST((k + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 20 AS {STR})) AS last_cell;
 17.0E0 + 0.02E0 * (k % 20) AS lat; 82.0E0 + 0.03E0 * (k % 5) AS lon; k >= 95 AS is_provider_message""", None, False),
    "cdr": ("cdr_both", _CDR.format(t="us"), None, False),
    "cdr_dense": ("cdr_both", _CDR.format(t="dus"), None, False),
    # who calls whom in a sparse graph: rings of four with chords, and chains between them
    "call_links": ("cdr_both", """a_party AS src;
 CAST(9000000000 + CASE WHEN user_id % 12 = 3 THEN user_id - 3 ELSE user_id + 1 + event_id % 2 END AS {STR}) AS dst""", None, True),
    "calls": ("cdr", "*", "NOT is_provider_message", False),
    "calls_dense": ("cdr_dense", "*", "NOT is_provider_message", False),
    # source-shaped text columns with deliberate dirt, for the readers and validators
    "cdr_raw": ("cdr_both", """event_id; us;
 CASE WHEN event_id % 17 = 0 THEN concat('+91', a_party) WHEN event_id % 23 = 0 THEN '12345'
   WHEN event_id % 29 = 0 THEN NULL ELSE a_party END AS a_party;
 CASE WHEN event_id % 31 = 0 THEN concat(' ', b_party, ' ') WHEN event_id % 37 = 0 THEN NULL
   WHEN event_id % 41 = 0 THEN lower(b_party) ELSE b_party END AS b_party;
 CASE WHEN event_id % 19 = 0 THEN 'not a date' WHEN event_id % 43 = 0 THEN NULL ELSE {DAY} END AS date;
 CASE WHEN event_id % 21 = 0 THEN '99' ELSE {CLOCK} END AS time;
 CASE WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 47 = 0 THEN '-5' ELSE CAST(duration_seconds AS {STR}) END AS duration;
 CASE WHEN event_id % 53 = 0 THEN 'MMS' ELSE call_type END AS call_type;
 first_cell; last_cell; concat('Site ', first_cell) AS address;
 CASE WHEN event_id % 11 = 0 THEN substr(imei, 1, 14) ELSE imei END AS imei;
 CASE WHEN event_id % 59 = 0 THEN NULL ELSE imsi END AS imsi;
 CASE WHEN event_id % 61 = 0 THEN lat + 100 ELSE lat END AS lat;
 CASE WHEN event_id % 67 = 0 THEN NULL ELSE lon END AS lon""", None, False),
    "ipdr": ("ev", _IPDR.format(t="us", f=60), None, False),
    "ipdr_dense": ("ev", _IPDR.format(t="dus", f=2), None, False),
    "ipdr_raw": ("ipdr", """event_id; us; end_us; subject; protocol; start_time;
 CASE WHEN event_id % 31 = 0 THEN {TS}(us - 60000000) ELSE end_time END AS end_time;
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE subscriber_id END AS subscriber_id;
 CASE WHEN event_id % 13 = 0 THEN '10.0.300' ELSE concat('10.0.0.', CAST(event_id % 250 AS {STR})) END AS destination_ip;
 CASE WHEN event_id % 19 = 0 THEN 70000 WHEN event_id % 23 = 0 THEN NULL ELSE destination_port END AS destination_port;
 CASE WHEN event_id % 37 = 0 THEN -1 ELSE data_volume_up END AS data_volume_up; data_volume_down""", None, False),
    "tower_dump": ("cdr_both", _TOWER.format(t="us"), None, False),
    "tower_dump_dense": ("cdr_both", _TOWER.format(t="dus"), None, False),
    # two dumps that overlap in time and share devices
    "dumps": ("tower_dump", """event_id; mobile_number; timestamp; tower_id; duration; imei; imsi; us;
 CASE WHEN us < 1705363200000000 THEN 'D1' ELSE 'D2' END AS dump_id""", None, False),
    "tower_raw": ("tower_dump", """event_id; us; lat; lon AS long; duration;
 CASE WHEN event_id % 17 = 0 THEN concat('+91', mobile_number) WHEN event_id % 23 = 0 THEN '555'
   WHEN event_id % 29 = 0 THEN concat('91', mobile_number) ELSE mobile_number END AS mobile_number;
 CASE WHEN event_id % 11 = 0 THEN '123' ELSE imei END AS imei; CASE WHEN event_id % 13 = 0 THEN NULL ELSE imsi END AS imsi;
 concat(' ', tower_id) AS tower_id; timestamp; {DAY} AS date; {CLOCK} AS time""", None, False),
    "towers": ("ev", """concat('T', CAST(k % 20 AS {STR})) AS tower_id; 17.0E0 + 0.02E0 * (k % 20) AS lat;
 82.0E0 + 0.03E0 * (k % 5) AS lon; 1.0E0 AS coverage_radius""", None, True),
    # some parties known under another number in one source, so that parties exist which only
    # one or two of the sources know
    "cdr_part": ("cdr", """subject; datetime; event_id;
 CASE WHEN CAST(a_party AS BIGINT) % 4 = 1 THEN concat('8', substr(a_party, 2)) ELSE a_party END AS a_party; b_party;
 duration_seconds; call_type; imei; imsi; first_cell; last_cell; lat; lon; is_provider_message; us""", None, False),
    "ipdr_part": ("ipdr", """event_id; CASE WHEN CAST(subject AS BIGINT) % 3 = 1 THEN concat('7', substr(subject, 2)) ELSE subject END AS subject;
 subscriber_id; start_time; end_time; destination_port; protocol; data_volume_up; data_volume_down; us; end_us""", None, False),
}


def _fill(text: str, dialect: dict[str, str]) -> str:
    for name, value in dialect.items():
        text = text.replace("{" + name + "}", value)
    return text


class Views:
    """Lazy Spark side of the views: ``Views(spark, folder).cdr`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        source, exprs, where, distinct = VIEWS[name]
        df = getattr(self, source)
        if where:
            df = df.where(_fill(where, SPARK))
        df = df.selectExpr(*[_fill(e.strip(), SPARK) for e in exprs.split(";")])
        df = df.distinct() if distinct else df
        setattr(self, name, df)
        return df


def with_views(body: str) -> str:
    """Prefix a query with the common table expressions it needs, directly or indirectly."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        if VIEWS[name][0] in VIEWS:
            visit(VIEWS[name][0])
        needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body, re.I):
            visit(name)
    parts = []
    for name in needed:
        source, exprs, where, distinct = VIEWS[name]
        columns = ", ".join(_fill(e.strip(), PLAIN) for e in exprs.split(";"))
        text = f"SELECT {'DISTINCT ' if distinct else ''}{columns} FROM {source}"
        parts.append(f"{name} AS ({text}{' WHERE ' + _fill(where, PLAIN) if where else ''})")
    own = body.strip().rstrip(";")
    if not parts:
        return own
    recursive = ""
    if own[:5].upper() == "WITH ":
        own = own[5:].lstrip()
        if own[:10].upper() == "RECURSIVE ":
            recursive, own = "RECURSIVE ", own[10:].lstrip()
        return f"WITH {recursive}{', '.join(parts)}, {own}"
    return f"WITH {', '.join(parts)} {own}"
