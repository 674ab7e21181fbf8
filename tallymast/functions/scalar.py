"""Cleaning, calendar and lookup expressions.  All are plain Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(part: Column, whole: Column) -> Column:
    """Percentage that is 0 for an empty whole."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def level(*bands: tuple[Column, str], default: str = "LOW") -> Column:
    """First band whose condition is true (null counts as false)."""
    out = None
    for cond, name in bands:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def points(*bands: tuple[Column, int]) -> Column:
    out = None
    for cond, n in bands:
        out = F.when(cond, F.lit(n)) if out is None else out.when(cond, F.lit(n))
    return out.otherwise(F.lit(0))


# -- identifiers -------------------------------------------------------------------------

def is_provider(c: Column | str) -> Column:
    """True where the text carries a service code or starts with a two-letter sender prefix."""
    anywhere = "|".join(re.escape(code) for code in tables.PROVIDER_CODES)
    return F.coalesce(F.upper(F.trim(col(c))).rlike(f"(?:{anywhere})|^[A-Z]{{2}}-"), F.lit(False))


def clean_phone(c: Column | str) -> Column:
    """Trimmed service code, or only the digits of a number; null becomes the empty text."""
    text = F.trim(col(c))
    return F.coalesce(
        F.when(is_provider(text), text).otherwise(F.regexp_replace(text, r"\D", "")), F.lit("")
    )


def msisdn(c: Column | str) -> Column:
    """Ten-digit number or null.

    Deviation F2: 91 is a country code only where twelve digits are present, so a
    ten-digit number that starts with 91 is kept whole; one rule for all sources.
    """
    digits = F.regexp_replace(F.trim(col(c)), r"\D", "")
    local = F.when(digits.rlike(r"^91\d{10}$"), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(local.rlike(r"^\d{10}$"), local)


def clean_subscriber(c: Column | str) -> Column:
    return F.trim(F.replace(col(c), F.lit("+91"), F.lit("")))


def fifteen_digits(c: Column | str) -> Column:
    return F.when(F.trim(col(c)).rlike(r"^\d{15}$"), F.trim(col(c)))


def mask_last4(c: Column | str) -> Column:
    return F.right(col(c), F.lit(4))


def clean_text(c: Column | str) -> Column:
    """Line and paragraph separators become newlines, other separators beyond Latin-1 a
    space, everything else beyond Latin-1 a question mark."""
    text = F.regexp_replace(col(c), "\\u2028", "\n")
    text = F.regexp_replace(text, "\\u2029", "\n\n")
    text = F.regexp_replace(text, r"[\p{Z}&&[^\u0000-\u00FF]]", " ")
    return F.regexp_replace(text, r"[^\u0000-\u00FF]", "?")


# -- time --------------------------------------------------------------------------------

def us(c: Column | str) -> Column:
    return F.unix_micros(col(c))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (us(later) - us(earlier)) / F.lit(1e6)


def bin_start(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned tumbling bin."""
    width = F.lit(seconds * 1_000_000)
    return F.timestamp_micros(us(ts) - F.pmod(us(ts), width))


def cdr_timestamp(date: Column | str, time: Column | str) -> Column:
    """Date text + time text, null where unreadable.  Deviation F26: a date that already
    carries a midnight time is cut to the date first."""
    day = F.substring(F.trim(col(date).cast("string")), 1, 10)
    joined = F.concat_ws(" ", F.when(day != "", day), F.trim(col(time)))
    attempts = [
        F.try_to_timestamp(joined, F.lit(f))
        for f in ("yyyy-MM-dd H:mm:ss", "dd-MM-yyyy H:mm:ss", "dd/MM/yyyy H:mm:ss", "yyyy/MM/dd H:mm:ss")
    ]
    return F.when(day.isNotNull() & col(time).isNotNull(), F.coalesce(*attempts))


def tower_timestamp(text: Column | str) -> Column:
    """Six explicit formats in order, then Spark's own reading."""
    text = F.trim(col(text))
    attempts = [F.try_to_timestamp(text, F.lit(f)) for f in tables.TOWER_TIME_FORMATS]
    return F.coalesce(*attempts, text.try_cast("timestamp"))


def tower_date_time(date: Column | str, time: Column | str) -> Column:
    """Spreadsheet serial day (day 0 is 1899-12-30) or date text, plus a time of day."""
    date = F.trim(col(date))
    serial = F.when(date.rlike(r"^\d+(\.\d+)?$"), F.floor(date.try_cast("double")).cast("int"))
    day = F.coalesce(
        F.date_add(F.lit("1899-12-30").cast("date"), serial),
        F.substring(date, 1, 10).try_cast("date"),
    )
    return F.try_to_timestamp(
        F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.trim(col(time))),
        F.lit("yyyy-MM-dd HH:mm:ss"),
    )


def day_name(ts: Column | str) -> Column:
    return F.date_format(col(ts), "EEEE")


def is_weekend(ts: Column | str) -> Column:
    return F.dayofweek(col(ts)).isin(1, 7)


def odd_hour(ts: Column | str, start: int = 0, end: int = 5) -> Column:
    """Hour in ``[start, end)``.  Deviation F3: the end is always explicit; call and session
    records use 5, tower records use 6 (hours 0-5)."""
    hour = F.hour(col(ts))
    return (hour >= start) & (hour < end)


def with_calendar(df: DataFrame, ts: str, odd: tuple[int, int] = (0, 5)) -> DataFrame:
    return df.select(
        "*",
        F.hour(ts).alias("hour"),
        day_name(ts).alias("day_of_week"),
        F.to_date(ts).alias("date"),
        odd_hour(ts, *odd).alias("is_odd_hour"),
        is_weekend(ts).alias("is_weekend"),
    )


def connection_type(c: Column | str) -> Column:
    """Half-open bins; zero, negative and null have no class."""
    c = col(c)
    return (
        F.when(c <= 0, F.lit(None))
        .when(c <= 10, "brief").when(c <= 60, "short").when(c <= 300, "normal").when(c > 300, "long")
    )


# -- applications and ports --------------------------------------------------------------

def fingerprint_app(port: Column | str, proto: Column | str) -> Column:
    """First signature that lists the port; some applications also need TCP.

    Kept as observed (F6): telegram can never be reached behind whatsapp, and the
    messaging result for port 443 depends only on the transport.
    """
    port = col(port).try_cast("bigint")
    tcp = F.coalesce(F.upper(col(proto)) == "TCP", F.lit(False))
    out = None
    for app, (ports, _, _) in tables.APP_SIGNATURES.items():
        cond = port.isin(ports) & tcp if app in tables.TCP_ONLY_APPS else port.isin(ports)
        out = F.when(cond, app) if out is None else out.when(cond, app)
    return out


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def app_risk(app: Column | str) -> Column:
    risks = {name: risk for name, (_, risk, _) in tables.APP_SIGNATURES.items()}
    return F.coalesce(_lookup(risks, F.coalesce(col(app), F.lit(""))), F.lit("LOW"))


def is_encrypted(app: Column | str) -> Column:
    return F.coalesce(col(app).isin(tables.ENCRYPTED_APPS), F.lit(False))


def port_service(port: Column | str) -> Column:
    key = F.coalesce(col(port).try_cast("int"), F.lit(-1))
    return F.coalesce(_lookup(tables.PORT_SERVICES, key), F.lit("Unknown"))


# -- movement ----------------------------------------------------------------------------

def movement_class(kmh: Column | str) -> Column:
    kmh = col(kmh)
    return (
        F.when(kmh < 1, "stationary").when(kmh < 5, "walking").when(kmh < 25, "bicycle")
        .when(kmh < 200, "vehicle").when(kmh > 500, "impossible").when(kmh.isNotNull(), "vehicle")
    )
