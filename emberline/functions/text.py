"""Formatting and parsing of sizes, durations, addresses and line lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.basics import as_col, bind, fixed_point, int_div, trim_space

# Binary size units, and duration units in seconds.
SIZE_UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
SIZE_SUFFIXES = {"KB": 1024, "MB": 1024**2, "GB": 1024**3}
DURATION_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}

_NUMBER = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_UNIT = "(?:ns|us|µs|μs|ms|s|m|h)"


def byte_length(text) -> Column:
    return F.octet_length(as_col(text))


def format_bytes(size) -> Column:
    """``512 B``, ``1.5 KiB`` ... ``2.0 EiB``."""
    n = as_col(size)
    shown = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS, start=1):
        scaled = F.concat(fixed_point(n.cast("double") / F.lit(float(1024**power)), 1), F.lit(f" {unit}"))
        shown = F.when(n >= F.lit(1024**power), scaled).otherwise(shown)
    return shown


def format_duration(seconds) -> Column:
    """``1d 2h 3m``, ``2h 3m 4s``, ``3m 4s`` or ``4s``, rounded to whole seconds."""
    s = F.round(as_col(seconds), 0).cast("long")
    days, hours = int_div(s, 86400), int_div(s % 86400, 3600)
    minutes, rest = int_div(s % 3600, 60), s % 60
    return (
        F.when(days > 0, F.format_string("%dd %dh %dm", days, hours, minutes))
        .when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def parse_duration(text, mode: str = "compound") -> Column:
    """Seconds as DOUBLE.

    ``compound``: ``1h30m``, ``1.5s``, ``-2ms``, NULL when malformed.
    ``simple``: whole number and one of s/m/h, 0 when malformed; ``minutes``:
    the same with only s/m.
    """
    t = as_col(text)
    if mode != "compound":
        units = {"simple": "smh", "minutes": "sm"}[mode]
        factor = F.when(t.endswith("s"), 1.0).when(t.endswith("m"), 60.0).otherwise(3600.0)
        amount = F.regexp_extract(t, r"^\+?([0-9]+).$", 1).try_cast("double")
        return F.when(t.rlike(rf"^\+?[0-9]+[{units}]$"), amount * factor).otherwise(0.0)
    parts = F.regexp_extract_all(t, F.lit(f"({_NUMBER}{_UNIT})"), 1)
    unit_of = lambda p: F.regexp_extract(p, r"([^0-9.]+)$", 1)
    value_of = lambda p: F.regexp_extract(p, r"^([0-9.]+)", 1).try_cast("double")
    factors = F.create_map(*[F.lit(x) for pair in DURATION_UNITS.items() for x in pair])
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + value_of(p) * F.try_element_at(factors, unit_of(p)))
    signed = F.when(t.startswith("-"), -total).otherwise(total)
    return F.when(t.rlike(rf"^[-+]?(?:0|(?:{_NUMBER}{_UNIT})+)$"), signed)


def parse_size(text) -> Column:
    """``100MB`` to bytes; a plain number is bytes; no leading digits give 0."""
    t = F.upper(as_col(text))
    number = F.coalesce(F.regexp_extract(trim_space(t), r"^([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0))
    factor = F.lit(1).cast("long")
    for suffix, size in SIZE_SUFFIXES.items():
        factor = F.when(t.endswith(suffix), F.lit(size).cast("long")).otherwise(factor)
    return (number * factor).cast("long")


def parse_dsn(dsn) -> Column:
    """``STRUCT<public_key, host, project_id, endpoint>`` of ``https://key@host/path/id``."""
    t = as_col(dsn)
    get = lambda g: F.regexp_extract(
        t, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:([^@/:?#]*)(?::[^@/?#]*)?@)?([^/:?#@]+)(?::[0-9]*)?(/[^?#]*)?", g
    )
    return bind(
        F.struct(get(1).alias("k"), get(2).alias("h"), F.substring_index(get(3), "/", -1).alias("p")),
        lambda s: F.when(
            s["h"] != "",
            F.struct(
                s["k"].alias("public_key"),
                s["h"].alias("host"),
                s["p"].alias("project_id"),
                F.concat(F.lit("https://"), s["h"], F.lit("/api/"), s["p"], F.lit("/store/")).alias("endpoint"),
            ),
        ),
    )
