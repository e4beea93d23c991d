"""Host statistics and their attachment to events."""

from pyspark.sql import functions as F

from emberline.catalog import Catalog
from emberline.catalog.common import SECONDS_SQL, table
from emberline.functions import hostinfo as H
from emberline.operators import hosts as O
from emberline.plans.fixtures import epoch_seconds

CATALOG = Catalog()
add = CATALOG.add

SAMPLES_SQL = """samples AS (SELECT 'h' || (user_id % 4) AS host, CAST(date_trunc('day', ts) AS TIMESTAMP) AS snapshot_ts, user_id AS pid,
  max(event_id) AS utime, count(*) AS stime, user_id * 100 AS starttime, max(event_id) % 977 AS rss_pages, 100000 AS uptime,
  CAST(16777216 AS BIGINT) AS total_mem FROM events GROUP BY ALL)"""
CPU_SQL = "CASE WHEN uptime > starttime / 100.0 THEN CAST(utime + stime AS DOUBLE) / 100.0 / (uptime - starttime / 100.0) * 100.0 ELSE 0 END"
MEM_SQL = "CAST(rss_pages * 4096 AS DOUBLE) / CAST(total_mem AS DOUBLE) * 100.0"


def samples(spark, sf):
    user = F.col("user_id")
    grouped = table(spark, sf, "events").groupBy(
        F.concat(F.lit("h"), (user % 4).cast("string")).alias("host"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("snapshot_ts"), user.alias("pid"),
    ).agg(F.max("event_id").alias("utime"), F.count(F.lit(1)).alias("stime"))
    args = F.when(F.col("pid") % 3 == 0, F.array(F.lit("srv"), F.lit("--token"), F.col("pid").cast("string")))
    return grouped.select(
        "*", (F.col("pid") * 100).alias("starttime"), (F.col("utime") % 977).alias("rss_pages"),
        F.lit(100000).alias("uptime"), F.lit(16777216).cast("long").alias("total_mem"),
        args.otherwise(F.array().cast("array<string>")).alias("cmdline"),
        F.when(F.col("pid") % 3 == 1, F.concat(F.lit("comm"), F.col("pid").cast("string"))).alias("comm"),
    )


@add("cpu_mem_percent", f"""
WITH {SAMPLES_SQL} SELECT host, snapshot_ts, pid, rss_pages * 4096 AS rss_bytes, CAST(floor({CPU_SQL} * 1000 + 0.0001) AS BIGINT) AS cpu_milli,
  CAST(floor({MEM_SQL} * 1000 + 0.0001) AS BIGINT) AS mem_milli FROM samples""")
def cpu_mem_percent(spark, sf):
    milli = lambda c: F.floor(F.col(c) * 1000 + F.lit(0.0001))
    usage = O.process_usage(samples(spark, sf))
    return usage.select(
        "host", "snapshot_ts", "pid", "rss_bytes", milli("cpu_usage").alias("cpu_milli"), milli("mem_usage").alias("mem_milli")
    )


@add("top_processes", f"""
WITH {SAMPLES_SQL}, u AS (SELECT *, {CPU_SQL} AS cpu FROM samples),
r AS (SELECT *, row_number() OVER (PARTITION BY host, snapshot_ts ORDER BY cpu DESC, pid) AS rank FROM u)
SELECT host, snapshot_ts, pid, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def top_processes(spark, sf):
    top = O.top_processes(O.process_usage(samples(spark, sf)), "cpu_usage")
    return top.select("host", "snapshot_ts", "pid", "rank")


@add("process_summary", f"""
WITH {SAMPLES_SQL} SELECT host, snapshot_ts, 'Total Processes: ' || count(*) AS process_summary FROM samples GROUP BY ALL""")
def process_summary(spark, sf):
    return O.process_summary(samples(spark, sf))


@add("host_snapshots", f"""
WITH {SAMPLES_SQL}, u AS (SELECT *, {CPU_SQL} AS cpu, {MEM_SQL} AS mem FROM samples),
r AS (SELECT *, row_number() OVER (PARTITION BY host, snapshot_ts ORDER BY cpu DESC, pid) AS rc,
  row_number() OVER (PARTITION BY host, snapshot_ts ORDER BY mem DESC, pid) AS rm,
  pid || '|' || (rss_pages * 4096) || '|' || printf('%.1f', mem) || '|' || CASE pid % 3 WHEN 0 THEN 'srv --token [REDACTED]' WHEN 1 THEN 'comm' || pid ELSE 'unknown' END AS shown FROM u)
SELECT host, snapshot_ts, string_agg(shown, ';' ORDER BY rc) FILTER (rc <= 5) AS top_cpu, string_agg(shown, ';' ORDER BY rm) FILTER (rm <= 5) AS top_mem,
  'Total Processes: ' || count(*) AS process_summary FROM r GROUP BY host, snapshot_ts""")
def host_snapshots(spark, sf):
    shown = lambda c: F.array_join(
        F.transform(c, lambda p: F.concat_ws("|", p["pid"], p["rss"], p["mem"], p["command"])), ";"
    ).alias(c)
    return O.snapshots(samples(spark, sf)).select("host", "snapshot_ts", shown("top_cpu"), shown("top_mem"), "process_summary")


STATES_SQL = f"""s AS (SELECT 'h' || (user_id % 4) AS host, {SECONDS_SQL} // 3600 * 3600 + 600 AS at, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2),
e AS (SELECT 'h' || (user_id % 4) AS host, event_id, {SECONDS_SQL} AS at FROM events)"""


@add("attach_state_asof", f"""
WITH {STATES_SQL} SELECT e.event_id, CAST(s.at AS BIGINT) AS state_ts, s.n AS state_n FROM e ASOF LEFT JOIN s ON e.host = s.host AND e.at >= s.at""")
def attach_state_asof(spark, sf):
    events = table(spark, sf, "events").select(
        F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("host"), "event_id", epoch_seconds().alias("at")
    )
    hour = F.floor(F.col("at") / 3600) * 3600 + 600
    states = events.groupBy("host", hour.cast("double").alias("snapshot_ts")).agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    sent = events.withColumn("sent_ts", F.col("at").cast("double"))
    joined = O.attach_server_state(sent, O.server_state(states), "sent_ts")
    return joined.select(
        "event_id", F.col("server_state.timestamp").cast("bigint").alias("state_ts"), F.col("server_state.n").alias("state_n")
    )


@add("parse_psi", """
SELECT event_id, CAST(user_id AS BIGINT) AS avg10, event_id % 50 AS avg60, CAST(0 AS BIGINT) AS avg300, event_id AS total FROM events""")
def parse_psi(spark, sf):
    num = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("full avg10=1.00 total=1\nsome avg10="), num("user_id"), F.lit(".00 avg60="), (F.col("event_id") % 50).cast("string"),
        F.lit(".00 avg300=bad total="), num("event_id"),
    )
    parsed = table(spark, sf, "events").select("event_id", H.parse_psi(text).alias("p"))
    return parsed.select("event_id", *[F.col(f"p.{k}").cast("bigint").alias(k) for k in H.PRESSURE_KEYS])


@add("parse_proc_stat", """
SELECT event_id, event_id * 3 AS utime, user_id AS stime, event_id + 7 AS starttime, user_id * 2 AS rss FROM events""")
def parse_proc_stat(spark, sf):
    num = lambda c: c.cast("string")
    event, user = F.col("event_id"), F.col("user_id")
    text = F.concat(
        num(event), F.lit(" (a ) b) S 1 2 3 4 5 6 7 8 9 10 "), num(event * 3), F.lit(" "), num(user),
        F.lit(" 0 0 20 0 1 0 "), num(event + 7), F.lit(" 99 "), num(user * 2), F.lit(" 1 1"),
    )
    return table(spark, sf, "events").select("event_id", H.parse_proc_stat(text).alias("p")).select("event_id", "p.*")


@add("parse_meminfo", """
SELECT event_id, (event_id + 1000) * 1024 AS total, user_id * 1024 AS available, (event_id + 1000 - user_id) * 1024 AS used,
  CAST(floor((event_id + 1000 - user_id) * 1000 / (event_id + 1000) + 0.0001) AS BIGINT) AS used_permille FROM events""")
def parse_meminfo(spark, sf):
    text = F.concat(
        F.lit("MemTotal:       "), (F.col("event_id") + 1000).cast("string"), F.lit(" kB\nMemFree: 5 kB\nMemAvailable:   "),
        F.col("user_id").cast("string"), F.lit(" kB\n"),
    )
    parsed = table(spark, sf, "events").select("event_id", H.parse_meminfo(text).alias("p"))
    return parsed.select(
        "event_id", "p.total", "p.available", "p.used", F.floor(F.col("p.used_percent") * 10 + F.lit(0.0001)).alias("used_permille")
    )


@add("parse_load_uptime", """
SELECT event_id, user_id * 10 AS load1, event_id * 10 + 5 AS load5, CAST(0 AS BIGINT) AS load15, event_id AS uptime FROM events""")
def parse_load_uptime(spark, sf):
    text = F.concat(F.col("user_id").cast("string"), F.lit(".0 "), F.col("event_id").cast("string"), F.lit(".5 0.0 1/2 9"))
    up = F.concat(F.col("event_id").cast("string"), F.lit(".99 12.0"))
    parsed = table(spark, sf, "events").select("event_id", H.parse_loadavg(text).alias("p"), H.parse_uptime(up).alias("uptime"))
    return parsed.select(
        "event_id", *[F.round(F.col(f"p.{k}") * 10).cast("bigint").alias(k) for k in ("load1", "load5", "load15")], "uptime"
    )
