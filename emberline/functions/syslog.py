"""Syslog priority and the levels derived from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.basics import as_col, bind, found, int_div

# Syslog severity 0..7 as an event level.
SEVERITY_LEVELS = ("fatal", "fatal", "fatal", "error", "warning", "info", "info", "debug")
DEFAULT_LEVEL = "info"


def syslog_priority(line) -> Column:
    """``STRUCT<pri, facility, severity>`` from a leading ``<1-3 digits>``, or NULL."""
    pri = found(as_col(line), r"^<([0-9]{1,3})>", 1).cast("int")
    return bind(
        pri,
        lambda p: F.when(
            p.isNotNull(),
            F.struct(
                p.alias("pri"),
                int_div(p, 8).cast("int").alias("facility"),
                (p % 8).cast("int").alias("severity"),
            ),
        ),
    )


def level_from_syslog(severity) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in SEVERITY_LEVELS]), as_col(severity) + 1)


def event_level(context_level: Column, syslog_level: Column) -> Column:
    """JSON context beats syslog severity beats the default."""
    return F.coalesce(context_level, syslog_level, F.lit(DEFAULT_LEVEL))
