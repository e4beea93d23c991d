"""Timestamps, syslog priorities and levels."""

from pyspark.sql import functions as F

from emberline.catalog import Catalog
from emberline.catalog.common import LEVEL_SQL, LINE_SQL, SECONDS_SQL, UPTIME_SQL, lines, lines_sql, table
from emberline.functions import syslog as S
from emberline.functions import timestamps as T
from emberline.functions.jsonlines import json_context, level_from_context
from emberline.operators.detect import detector_for
from emberline.plans.fixtures import FORMATS, line_of

CATALOG = Catalog()
add = CATALOG.add

AS_OF = 1706745600.0  # 2024-02-01
STAMP_SQL = {
    "iso": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "nginx": "strftime(ts, '%Y/%m/%d %H:%M:%S')",
    "access": "strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000'",
    "syslog": "strftime(ts, '%b %d %H:%M:%S')",
    "dmesg": f"CASE WHEN event_id % 10 = 9 THEN '' ELSE {UPTIME_SQL} || '.000000' END",
    "json": "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'",
}


def parsed(df, tagged, *columns):
    """Whole seconds and stamp text, by the staged operator."""
    staged = T.with_parsed(df, tagged, AS_OF)
    return staged.select(*columns, F.col("ts").cast("bigint").alias("ts"), "ts_str")


def simple(name, fmt, tagged):
    sql = f"WITH {lines_sql(fmt)} SELECT line_no, CAST({SECONDS_SQL} AS BIGINT) AS ts, {STAMP_SQL[fmt]} AS ts_str FROM lines"

    @add(name, sql)
    def query(spark, sf):
        return parsed(lines(spark, sf, fmt), tagged("line"), "line_no")


simple("ts_iso8601", "iso", T.tagged_iso)
simple("ts_nginx_error", "nginx", T.tagged_nginx_error)
simple("ts_nginx_access", "access", T.tagged_nginx_access)
simple("ts_syslog", "syslog", T.tagged_syslog)
simple("ts_json", "json", T.tagged_json)


@add("ts_iso8601_zone", f"""
SELECT event_id, CAST(({SECONDS_SQL} - 19800) * 1000 + 250 AS BIGINT) AS ms,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250+05:30' AS ts_str FROM events""")
def ts_iso8601_zone(spark, sf):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250+05:30 x"))
    found = table(spark, sf, "events").select("event_id", T.parse_iso8601(line).alias("t"))
    return found.select("event_id", F.round(F.col("t.ts") * 1000).cast("bigint").alias("ms"), F.col("t.ts_str"))


@add("ts_access_offset", f"""
SELECT event_id, CAST({SECONDS_SQL} + 25200 AS BIGINT) AS ts FROM events""")
def ts_access_offset(spark, sf):
    line = F.concat(F.lit("[x] ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" -0700]"))
    return table(spark, sf, "events").select("event_id", T.parse_nginx_access(line)["ts"].cast("bigint").alias("ts"))


@add("ts_syslog_last_year", f"""
SELECT event_id, CAST(t - CASE WHEN t - 1707523200 > 2592000 THEN 366 * 86400 ELSE 0 END AS BIGINT) AS ts
FROM (SELECT event_id, {SECONDS_SQL} + 60 * 86400 AS t FROM events)""")
def ts_syslog_last_year(spark, sf):
    # Dates in March seen from 10 February: more than 30 days ahead means last year.
    later = F.date_format(F.col("ts") + F.expr("INTERVAL '60' DAY"), "MMM dd HH:mm:ss")
    line = F.concat(F.lit("<14>"), later, F.lit(" host app: x"))
    return table(spark, sf, "events").select(
        "event_id", T.parse_syslog_ts(line, 1707523200.0)["ts"].cast("bigint").alias("ts")
    )


@add("ts_dmesg", f"""
WITH {lines_sql('dmesg')} SELECT line_no, CAST(CASE WHEN event_id % 10 <> 9 THEN {UPTIME_SQL} END AS BIGINT) AS ts,
  CASE WHEN event_id % 10 <> 9 THEN {UPTIME_SQL} || '.000000' END AS ts_str FROM lines""")
def ts_dmesg(spark, sf):
    return parsed(lines(spark, sf, "dmesg"), T.tagged_dmesg("line"), "line_no")


def all_lines(spark, sf):
    pairs = [F.struct(F.lit(f).alias("fmt"), line_of(f).alias("line")) for f in FORMATS]
    return table(spark, sf, "events").select("event_id", F.inline(F.array(*pairs)))


ALL_SQL = " UNION ALL ".join(
    f"SELECT event_id, ts, user_id, event_type, '{f}' AS fmt, {LINE_SQL[f]} AS line, {STAMP_SQL[f]} AS stamp FROM events"
    for f in FORMATS
)
CASCADE_SQL = f"""
SELECT event_id, fmt, CASE WHEN fmt = 'json' OR stamp = '' THEN 0 WHEN fmt = 'dmesg' THEN {UPTIME_SQL} ELSE {SECONDS_SQL} END AS ts,
  CASE WHEN fmt = 'json' THEN '' ELSE stamp END AS ts_str FROM ({ALL_SQL})"""


@add("ts_cascade", CASCADE_SQL)
def ts_cascade(spark, sf):
    staged = T.with_timestamps(all_lines(spark, sf), as_of=AS_OF)
    return staged.select("event_id", "fmt", F.col("ts").cast("bigint").alias("ts"), "ts_str")


@add("ts_cascade_column", CASCADE_SQL)
def ts_cascade_column(spark, sf):
    found = all_lines(spark, sf).select("event_id", "fmt", T.extract_timestamp("line", AS_OF).alias("t"))
    return found.select("event_id", "fmt", F.col("t.ts").cast("bigint").alias("ts"), "t.ts_str")


@add("ts_detector_first", f"""
SELECT event_id, fmt, CASE WHEN stamp = '' THEN 0 WHEN fmt = 'dmesg' THEN {UPTIME_SQL} ELSE {SECONDS_SQL} END AS ts,
  stamp AS ts_str FROM ({ALL_SQL})""")
def ts_detector_first(spark, sf):
    staged = T.with_timestamps(all_lines(spark, sf), detector_for("json", "level:."), as_of=AS_OF)
    return staged.select("event_id", "fmt", F.col("ts").cast("bigint").alias("ts"), "ts_str")


@add("ts_group_key", f"""
SELECT event_id, fmt, CASE fmt WHEN 'iso' THEN strftime(ts, '%Y-%m-%d') WHEN 'nginx' THEN {LEVEL_SQL}
  WHEN 'access' THEN stamp WHEN 'syslog' THEN CAST(user_id AS VARCHAR)
  WHEN 'dmesg' THEN CASE WHEN stamp = '' THEN 'unknown' ELSE stamp END ELSE 'unknown' END AS ts_key FROM ({ALL_SQL})""")
def ts_group_key(spark, sf):
    return all_lines(spark, sf).select("event_id", "fmt", T.extract_timestamp_key("line").alias("ts_key"))


@add("ts_bracket", f"""
WITH {lines_sql('dmesg')} SELECT line_no, CASE WHEN event_id % 10 <> 9 THEN {UPTIME_SQL} || '.000000' END AS tag FROM lines""")
def ts_bracket(spark, sf):
    return lines(spark, sf, "dmesg").select("line_no", T.bracket_timestamp("line").alias("tag"))


@add("syslog_priority", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 11 ELSE 14 END AS pri, 1 AS facility,
  CASE WHEN event_type = 'error' THEN 3 ELSE 6 END AS severity FROM events""")
def syslog_priority(spark, sf):
    found = lines(spark, sf, "syslog", "event_id").select("event_id", S.syslog_priority("line").alias("p"))
    return found.select("event_id", "p.pri", "p.facility", "p.severity")


@add("syslog_level", """
SELECT event_id, CASE WHEN event_id % 8 <= 2 THEN 'fatal' WHEN event_id % 8 = 3 THEN 'error' WHEN event_id % 8 = 4 THEN 'warning'
  WHEN event_id % 8 <= 6 THEN 'info' ELSE 'debug' END AS level FROM events""")
def syslog_level(spark, sf):
    line = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">x"))
    found = table(spark, sf, "events").select("event_id", S.syslog_priority(line).alias("p"))
    return found.select("event_id", S.level_from_syslog("p.severity").alias("level"))


@add("context_level", f"""
SELECT event_id, CASE {LEVEL_SQL} WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'info' END AS level FROM events""")
def context_level(spark, sf):
    return lines(spark, sf, "json", "event_id").select("event_id", level_from_context("line").alias("level"))


@add("event_level", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'info' WHEN event_type = 'error' THEN 'error'
  WHEN event_id % 3 = 1 AND event_type = 'signup' THEN 'warning' ELSE 'info' END AS level FROM events""")
def event_level(spark, sf):
    n = F.col("event_id") % 3
    line = F.when(n == 0, F.lit("plain")).when(n == 1, line_of("json")).otherwise(line_of("syslog"))
    found = table(spark, sf, "events").select("event_id", line.alias("line"))
    severity = S.syslog_priority("line")["severity"]
    return found.select(
        "event_id", S.event_level(level_from_context("line"), S.level_from_syslog(severity)).alias("level")
    )


@add("json_context", f"""
WITH {lines_sql('json')} SELECT line_no, json_extract_string(line, '$.msg') AS msg, CAST(json_extract(line, '$.user_id') AS BIGINT) AS user_id FROM lines""")
def json_context_query(spark, sf):
    text = lines(spark, sf, "json").select("line_no", json_context("line").alias("c"))
    return text.select(
        "line_no", F.get_json_object("c", "$.msg").alias("msg"),
        F.get_json_object("c", "$.user_id").cast("bigint").alias("user_id"),
    )
