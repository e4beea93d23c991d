"""The whole path from lines to routed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.jsonlines import json_context
from emberline.functions.text import format_duration, parse_duration
from emberline.operators.batches import group_batches, sendable
from emberline.operators.detect import Detector, detect_all, format_of
from emberline.operators.events import build_events, tenant_of
from emberline.operators.hosts import attach_server_state
from emberline.operators.limits import limiter_window, rate_limit
from emberline.plans.storage import cut


def numbered_monitors(monitors: list[dict]) -> list[dict]:
    """The monitors with an ``id`` each, as several may have one name, and with their format."""
    return [{**m, "id": str(i), "format": format_of(m)} for i, m in enumerate(monitors)]


def by_monitor(values: dict[str, Column]) -> Column:
    """The value of the row's monitor, from a literal map; no join."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), F.col("monitor"))


def assigned(lines: DataFrame, monitors: list[dict]) -> DataFrame:
    """``monitor`` becomes the id. A line whose name several monitors have is a line of each, unless
    ``monitor_no`` tells the one (by position) that read it. Lines of unknown monitors go."""
    if "monitor_no" in lines.columns:
        return lines.withColumn("monitor", F.col("monitor_no").cast("string")).drop("monitor_no").filter(
            F.col("monitor").isin([m["id"] for m in monitors]))
    ids: dict[str, list[str]] = {}
    for m in monitors:
        ids.setdefault(m["name"], []).append(m["id"])
    if all(len(found) == 1 for found in ids.values()):
        return lines.withColumn("monitor", F.try_element_at(_literal({k: F.lit(v[0]) for k, v in ids.items()}), "monitor")).filter("monitor IS NOT NULL")
    known = F.try_element_at(_literal({k: F.array(*map(F.lit, v)) for k, v in ids.items()}), "monitor")
    return lines.withColumn("monitor", F.explode(known))


def _literal(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def events_of(batches: DataFrame, tenant: dict, monitors: list[dict], server_state: str | None = None) -> DataFrame:
    """Events of batches (and alerts) whose ``monitor`` is an id: built, with the tenant of their monitor and its name."""
    json_ids = [m["id"] for m in monitors if m["format"] == "json"]
    reader = Detector(
        "monitors", match=lambda line: F.lit(True),
        context=lambda line: F.when(F.col("monitor").isin(json_ids), json_context(line)),
    )
    if "alert" in batches.columns:
        limit = by_monitor({m["id"]: parse_duration(F.lit(m.get("max_inactivity") or "0s")) for m in monitors})
        text = F.when(F.col("alert") == "warning", F.concat(
            F.lit(": Monitor source inactivity detected (silence for "), format_duration(limit), F.lit(")"),
        )).otherwise(F.lit(": Monitor source activity resumed"))
        batches = batches.withColumn("message", F.when(
            F.col("alert").isNull(), F.col("message")).otherwise(F.concat(F.coalesce("source", F.lit("")), text)))
    events = build_events(batches, reader if json_ids else None, server_state)
    routes = {m["id"]: F.struct(*[F.lit(v).alias(k) for k, v in {**tenant_of(m, tenant), "name": m["name"]}.items()]) for m in monitors}
    routed = events.withColumn("_route", by_monitor(routes))
    return routed.withColumns({"monitor": F.col("_route.name"), **{f: F.col(f"_route.{f}") for f in ("dsn", "environment", "release")}}).drop("_route")


def issues_to_events(
    lines: DataFrame, tenant: dict, monitors: list[dict], as_of: float | None = None, clock: str = "start_ts",
    snapshots: DataFrame | None = None, host: Column | None = None,
) -> DataFrame:
    """Events of all monitors: detected, grouped, limited per source and routed.

    ``lines`` is ``(monitor, source, line_no, line)``; monitors of one name each have the lines
    under that name. All events come back, with ``passed`` telling the ones the limiter lets
    through. With ``snapshots`` (``host, snapshot_ts, server_state``) each event carries the latest one
    at or before its ``clock`` of ``host``, a Column over ``monitor`` (an id) and ``source``.
    """
    monitors = numbered_monitors(monitors)
    # A source of two monitors is two sequences; the key holds both and tells a missing source apart.
    own = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("~"))
    keyed = assigned(lines, monitors).withColumn("_source", F.col("source")).withColumn("source", F.concat("monitor", own))
    issues = cut(detect_all(keyed, monitors, as_of))
    batches = sendable(group_batches(issues, keep=("monitor", "_source"), stored=True), issues)
    limits = {
        "burst": by_monitor({m["id"]: F.lit(int(m.get("rate_limit_burst") or 0)) for m in monitors}),
        "seconds": by_monitor({m["id"]: limiter_window(m.get("rate_limit_window") or "") for m in monitors}),
    }
    limited = rate_limit(batches.withColumns(limits), F.col("burst"), F.col("seconds"), clock=clock)
    found = limited.withColumn("source", F.col("_source")).drop("burst", "seconds", "_source")
    if snapshots is not None:
        timed = found.withColumns({"host": host if host is not None else F.col("source"), "sent_ts": F.col(clock)})
        found = attach_server_state(timed, snapshots).drop("host", "sent_ts")
    return events_of(found, tenant, monitors, "server_state" if snapshots is not None else None)
