"""Events: one message with tags, level and contexts per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.jsonlines import json_object, level_from_object
from emberline.functions.syslog import event_level, level_from_syslog, syslog_priority


def _map_of(pairs: dict[str, Column]) -> Column:
    """A map without the entries whose value is NULL or empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def event_id(*identity: str) -> Column:
    """Stable identity of an event, so that a repeated delivery can be recognised: its source, the number of its
    first line, its message, and the columns ``identity`` that tell apart what these leave equal."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (*identity, "source", "first_line_no", "message")]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def first_line_metadata(batches: DataFrame, context=None) -> DataFrame:
    """Add ``syslog`` (priority struct), ``log_data`` (JSON text) and ``level``, all
    read from the first line of the batch."""
    data = context(F.col("first_line")) if context else F.lit(None).cast("string")
    named = F.lit(None).cast("string")
    if context:
        named = level_from_object(json_object("log_data"))
    return (
        batches.withColumn("syslog", syslog_priority("first_line"))
        .withColumn("log_data", data)
        .withColumn("level", event_level(named, level_from_syslog(F.col("syslog.severity"))))
    )


def build_events(batches: DataFrame, detector=None, server_state: str | None = None) -> DataFrame:
    """Event table of a batch table. ``server_state`` names a column holding a host
    snapshot (see ``attach_server_state``). ``monitor`` and ``begun`` (the micro-batch of the first
    line, where line numbers start anew in each) go into the identity where they are there. Rows with
    a level in ``alert`` are alerts of a silent source.
    """
    staged = first_line_metadata(batches, getattr(detector, "context", None))
    number = lambda f: F.col(f"syslog.{f}").cast("string")
    contexts = [F.col("log_data")]
    if server_state:
        contexts.append(F.col(server_state).alias("server_state"))
    passthrough = [c for c in ("monitor", "dsn", "environment", "release", "passed") if c in batches.columns]
    alert = F.col("alert") if "alert" in batches.columns else F.lit(None).cast("string")
    told = [c for c in ("monitor", "begun") if c in batches.columns]
    return staged.select(
        F.when(alert.isNotNull(), event_id(*told, "at") if "at" in batches.columns else None).otherwise(event_id(*told)).alias("event_id"),
        "source", "batch_id", "first_line_no", "start_ts", "n_lines",
        "message", F.coalesce(alert, "level").alias("level"),
        _map_of({
            "source": F.col("source").cast("string"),
            "alert_type": F.when(alert.isNotNull(), "inactivity"),
            "log_timestamp": F.col("ts_str"),
            "syslog_priority": number("pri"),
            "syslog_facility": number("facility"),
            "syslog_severity": number("severity"),
        }).alias("tags"),
        F.struct(F.col("message").alias("raw_line")).alias("extra"),
        F.struct(*contexts).alias("contexts"),
        *passthrough,
    )


def payload_json(
    groups: DataFrame, environment: str = "production", server_state: Column | None = None
) -> DataFrame:
    """JSON payload of timestamp groups (``source, ts_key, line_count, lines``): a fixed
    message and level, the lines inside."""
    stamp = F.col("ts_key")
    contexts = {} if server_state is None else {"Server State": server_state}
    body = F.to_json(F.struct(
        F.concat(F.lit("Log errors at timestamp ["), stamp, F.lit("]")).alias("message"),
        F.lit("error").alias("level"),
        F.lit(environment).alias("environment"),
        F.struct(stamp.alias("timestamp"), F.col("source").cast("string").alias("source")).alias("tags"),
        F.struct(F.struct(
            stamp.alias("timestamp"), F.col("line_count"), F.array_join("lines", "\n").alias("lines")
        ).alias("log_lines")).alias("extra"),
        *([F.struct(*[v.alias(k) for k, v in contexts.items()]).alias("contexts")] if contexts else []),
    ))
    return groups.withColumn("payload", body)


def route(events: DataFrame, monitors: DataFrame, dsn: str, environment: str = "production",
          release: str = "") -> DataFrame:
    """Add the tenant (``dsn, environment, release``) of each event's monitor.

    A monitor with its own address takes its own environment and release, each
    falling back to the global one; without an address all three are global.
    """
    own = monitors.select(
        F.col("name").alias("monitor"), F.col("dsn").alias("_dsn"), F.col("environment").alias("_env"),
        F.col("release").alias("_rel"),
    )
    has_own = F.coalesce(F.col("_dsn"), F.lit("")) != ""

    def pick(column: str, default: str) -> Column:
        return F.when(has_own, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))).otherwise(
            F.lit(default)
        )

    return events.join(own, "monitor", "left").withColumns({
        "dsn": pick("_dsn", dsn), "environment": pick("_env", environment), "release": pick("_rel", release),
    }).drop("_dsn", "_env", "_rel")


def tenant_of(monitor: dict, tenant: dict) -> dict[str, str]:
    """Address, environment and release of one monitor, by the rule of ``route``."""
    own = monitor.get("dsn") or ""
    return {f: (own and monitor.get(f)) or tenant.get(f) or "" for f in ("dsn", "environment", "release")}
