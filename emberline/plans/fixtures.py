"""Log lines derived from an event table, one template per format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("iso", "nginx", "access", "syslog", "dmesg", "json")
EPOCH_2024 = 1704067200


def epoch_seconds(ts: str = "ts") -> Column:
    """Whole epoch seconds of a timestamp without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))


def _level() -> Column:
    return F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def line_of(fmt: str) -> Column:
    """Line expression over the columns of ``events``."""
    shown = lambda pattern: F.date_format("ts", pattern)
    if fmt == "iso":
        return F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(" user="), _text("user_id"))
    if fmt == "nginx":
        return F.concat(
            shown("yyyy/MM/dd HH:mm:ss"), F.lit(" ["), _level(), F.lit("] "), _text("user_id"), F.lit("#0: *"),
            _text("event_id"), F.lit(" "), "event_type",
        )
    if fmt == "access":
        return F.concat(
            F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" - - ["),
            shown("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit('"'),
        )
    if fmt == "syslog":
        pri = F.when(F.col("event_type") == "error", "11").otherwise("14")
        return F.concat(
            F.lit("<"), pri, F.lit(">"), shown("MMM dd HH:mm:ss"), F.lit(" host app["), _text("user_id"),
            F.lit("]: "), "event_type",
        )
    if fmt == "dmesg":
        stamped = F.concat(
            F.lit("["), (epoch_seconds() - EPOCH_2024).cast("string"), F.lit(".000000] dev"),
            (F.col("user_id") % 3).cast("string"), F.lit(": "), "event_type",
        )
        return F.when(F.col("event_id") % 10 == 9, F.concat(F.lit(" cont "), _text("event_id"))).otherwise(stamped)
    if fmt == "json":
        return F.concat(
            F.lit('{"time":"'), shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z","level":"'), _level(), F.lit('","msg":"'),
            "event_type", F.lit('","user_id":'), _text("user_id"), F.lit("}"),
        )
    raise ValueError(f"unknown format: {fmt}")


def event_lines(events: DataFrame, fmt: str, *keep: str) -> DataFrame:
    """``(source, line_no, line)`` and the event columns named in ``keep``."""
    return events.select(
        F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string")).alias("source"),
        F.col("event_id").alias("line_no"), line_of(fmt).alias("line"), *keep,
    )
