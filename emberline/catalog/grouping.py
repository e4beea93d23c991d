"""Batches, limits, alerts, events, counters, routing and delivery."""

from pyspark.sql import functions as F

from emberline.catalog import Catalog
from emberline.catalog.common import SECONDS_SQL, UPTIME_SQL, anchored_sql, lines, lines_sql, table, windows_sql
from emberline.catalog.detection import DMESG_CONTEXT_SQL, NGINX_SQL
from emberline.operators import batches as B
from emberline.operators import events as E
from emberline.operators import limits as L
from emberline.operators.alerts import inactivity
from emberline.operators.detect import detector_for, generic_detector, mark_detected, mark_excluded, matched_lines
from emberline.operators.metrics import last_activity, metrics_rows, source_metrics
from emberline.plans.fixtures import epoch_seconds
from emberline.plans.flow import issues_to_events
from emberline.plans.storage import new_path
from emberline.sources.sinks import pending, read_events, write_events

CATALOG = Catalog()
add = CATALOG.add

HOUR = 3600.0
NGINX_MATCHED = f"""SELECT source, line_no, line, CAST({SECONDS_SQL} AS DOUBLE) AS ts, strlen(line) AS n_bytes, event_id
  FROM lines WHERE {NGINX_SQL}"""


def issues(spark, sf, fmt="nginx", *keep):
    return matched_lines(lines(spark, sf, fmt, *keep), detector_for("nginx" if fmt == "nginx" else fmt))


def batch_sql(window, max_lines, max_bytes, matched=NGINX_MATCHED, fmt="nginx"):
    return f"""WITH RECURSIVE {lines_sql(fmt)}, {anchored_sql(matched, window, max_lines, max_bytes)},
    b AS (SELECT w.source, w.batch_id, min(w.line_no) AS first_line_no, max(w.line_no) AS last_line_no,
      count(*) AS n_lines, CAST(sum(m.n_bytes) + count(*) - 1 AS BIGINT) AS n_bytes,
      string_agg(m.line, chr(10) ORDER BY m.line_no) AS message, arg_min(m.ts, m.line_no) AS start_ts
      FROM walk w JOIN m USING (source, rn) GROUP BY w.source, w.batch_id)"""


BATCH_COLUMNS = ["source", "batch_id", "first_line_no", "last_line_no", "n_lines", "n_bytes", "message"]
BATCH_SELECT = "SELECT " + ", ".join(BATCH_COLUMNS) + ", CAST(start_ts AS BIGINT) AS start_ts FROM b"


def shown(batches):
    return batches.select(*BATCH_COLUMNS, F.col("start_ts").cast("bigint").alias("start_ts"))


@add("batch_anchored", batch_sql(3600, 1000, 262144) + BATCH_SELECT)
def batch_anchored(spark, sf):
    return shown(B.group_batches(issues(spark, sf), window=HOUR))


@add("batch_default_window", batch_sql(5, 1000, 262144) + BATCH_SELECT)
def batch_default_window(spark, sf):
    return shown(B.group_batches(issues(spark, sf)))


@add("batch_capped", batch_sql(36000, 7, 250) + BATCH_SELECT)
def batch_capped(spark, sf):
    return shown(B.group_batches(issues(spark, sf), window=10 * HOUR, max_lines=7, max_bytes=250))


DMESG_MATCHED = f"""SELECT d.source, d.line_no,
    CASE WHEN event_id % 10 = 9 THEN d.line ELSE 'dev' || (user_id % 3) || ': ' || event_type END AS line,
    CAST(CASE WHEN event_id % 10 = 9 THEN 0 ELSE {UPTIME_SQL} END AS DOUBLE) AS ts,
    strlen(CASE WHEN event_id % 10 = 9 THEN d.line ELSE 'dev' || (user_id % 3) || ': ' || event_type END) AS n_bytes
  FROM ({DMESG_CONTEXT_SQL}) d JOIN events ON event_id = d.line_no"""


@add("batch_dmesg", batch_sql(7200, 1000, 262144, DMESG_MATCHED, "dmesg") + BATCH_SELECT)
def batch_dmesg(spark, sf):
    return shown(B.group_batches(issues(spark, sf, "dmesg"), window=2 * HOUR))


@add("batch_count_only", f"""
WITH {lines_sql('nginx')}, m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) - 1 AS rn FROM ({NGINX_MATCHED}))
SELECT source, rn // 100 AS batch_id, min(line_no) AS first_line_no, max(line_no) AS last_line_no, count(*) AS n_lines,
  CAST(sum(n_bytes) + count(*) - 1 AS BIGINT) AS n_bytes, string_agg(line, chr(10) ORDER BY line_no) AS message
FROM m GROUP BY ALL""")
def batch_count_only(spark, sf):
    return B.batches_by_count(issues(spark, sf), max_lines=100).select(*BATCH_COLUMNS)


@add("batch_conversations", """
WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS source, turn AS line_no, role || ': ' || text AS line,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations)
SELECT source, rn // 3 AS batch_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS message FROM m GROUP BY ALL""")
def batch_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("line_no"),
        F.concat("role", F.lit(": "), "text").alias("line"), F.lit(0.0).alias("ts"), F.lit("").alias("ts_str"),
    ).withColumn("n_bytes", F.octet_length("line").cast("long"))
    return B.batches_by_count(turns, max_lines=3).select("source", "batch_id", "n_lines", "message")


@add("group_by_timestamp", f"""
WITH {lines_sql('syslog')}, k AS (SELECT source, line_no, line, CAST(user_id AS VARCHAR) AS ts_key FROM lines WHERE event_type IN ('error', 'view')),
n AS (SELECT *, (row_number() OVER (PARTITION BY source, ts_key ORDER BY line_no) - 1) // 10 AS part FROM k)
SELECT source, ts_key, part, count(*) AS line_count, min(line_no) AS first_line_no, string_agg(line, chr(10) ORDER BY line_no) AS joined FROM n GROUP BY ALL""")
def group_by_timestamp(spark, sf):
    found = matched_lines(lines(spark, sf, "syslog"), generic_detector("(error|view)$"), as_of=1706745600.0)
    groups = B.group_by_timestamp(found, flush_lines=10)
    return groups.select(
        "source", "ts_key", "part", "line_count", "first_line_no", F.array_join("lines", "\n").alias("joined")
    )


@add("rate_limit", f"""
WITH RECURSIVE {windows_sql(f"SELECT 'src' || (user_id % 4) AS source, event_id AS ord, CAST({SECONDS_SQL} AS BIGINT) AS t FROM events", 14400)}
SELECT source, ord AS batch_id, pos < 5 AS passed FROM lim""")
def rate_limit(spark, sf):
    events = lines(spark, sf, "iso", "ts").select(
        "source", F.col("line_no").alias("batch_id"), epoch_seconds().alias("start_ts")
    )
    return L.rate_limit(events, burst=5, window=4 * HOUR).select("source", "batch_id", "passed")


@add("rate_limit_per_source", f"""
WITH RECURSIVE {windows_sql(f"SELECT 'src' || (user_id % 4) AS source, event_id AS ord, CAST({SECONDS_SQL} AS BIGINT) AS t FROM events", "CASE e.source WHEN 'src0' THEN 7200 WHEN 'src1' THEN 60 ELSE 0 END")}
SELECT source, ord AS batch_id, source = 'src3' OR pos < 2 AS passed FROM lim""")
def rate_limit_per_source(spark, sf):
    events = lines(spark, sf, "iso", "ts").select(
        "source", F.col("line_no").alias("batch_id"), epoch_seconds().alias("start_ts")
    )
    text = F.when(F.col("source") == "src0", "2h").when(F.col("source") == "src1", "1m").otherwise("bad")
    burst = F.when(F.col("source") == "src3", 0).otherwise(2)
    return L.rate_limit(events, burst, L.limiter_window(text)).select("source", "batch_id", "passed")


@add("limited_batches", batch_sql(3600, 1000, 262144) + f""",
{windows_sql("SELECT source, batch_id AS ord, start_ts AS t FROM b", 21600)}
SELECT source, ord AS batch_id, pos < 2 AS passed FROM lim""")
def limited_batches(spark, sf):
    batches = B.group_batches(issues(spark, sf), window=HOUR).select("source", "batch_id", "start_ts")
    return L.rate_limit(batches, burst=2, window=6 * HOUR).select("source", "batch_id", "passed")


@add("inactivity_alerts", f"""
WITH l AS (SELECT 'src' || (user_id % 4) AS source, event_id, CAST({SECONDS_SQL} AS DOUBLE) AS t FROM events),
g AS (SELECT source, lag(t) OVER (PARTITION BY source ORDER BY event_id) AS since, t AS til FROM l
      UNION ALL SELECT source, arg_max(t, event_id), NULL FROM l GROUP BY source)
SELECT source, 'warning' AS level, CAST(since + 1800 AS BIGINT) AS at FROM g WHERE coalesce(til, 1706745600) - since > 1800
UNION ALL SELECT source, 'info', CAST(til AS BIGINT) FROM g WHERE til - since > 1800""")
def inactivity_alerts(spark, sf):
    seen = lines(spark, sf, "iso", "ts").withColumn("ts", epoch_seconds())
    return inactivity(seen, 1800.0, as_of=1706745600.0).select("source", "level", F.col("at").cast("bigint").alias("at"))


SYSLOG_MATCHED = f"""SELECT source, line_no, line, CAST({SECONDS_SQL} AS DOUBLE) AS ts, strlen(line) AS n_bytes, event_type
  FROM lines WHERE event_type IN ('error', 'click')"""


def syslog_batches(spark, sf):
    found = matched_lines(lines(spark, sf, "syslog"), generic_detector("(error|click)$"), as_of=1706745600.0)
    return B.group_batches(found, window=HOUR)


@add("first_line_metadata", batch_sql(3600, 1000, 262144, SYSLOG_MATCHED, "syslog") + """
SELECT b.source, batch_id, CASE WHEN event_type = 'error' THEN 11 ELSE 14 END AS pri,
  CASE WHEN event_type = 'error' THEN 3 ELSE 6 END AS severity, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
  strftime(ts, '%b %d %H:%M:%S') AS ts_str FROM b JOIN events ON event_id = first_line_no""")
def first_line_metadata(spark, sf):
    staged = E.first_line_metadata(syslog_batches(spark, sf))
    return staged.select("source", "batch_id", "syslog.pri", "syslog.severity", "level", "ts_str")


@add("build_events", batch_sql(3600, 1000, 262144, SYSLOG_MATCHED, "syslog") + """
SELECT sha256(b.source || chr(31) || first_line_no || chr(31) || message) AS event_id, b.source, message, n_lines,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, strftime(ts, '%b %d %H:%M:%S') AS log_timestamp,
  CASE WHEN event_type = 'error' THEN '11' ELSE '14' END AS syslog_priority, '1' AS syslog_facility,
  CASE WHEN event_type = 'error' THEN '3' ELSE '6' END AS syslog_severity, message AS raw_line
FROM b JOIN events e ON e.event_id = first_line_no""")
def build_events(spark, sf):
    events = E.build_events(syslog_batches(spark, sf))
    tags = [F.col("tags")[t].alias(t) for t in ("log_timestamp", "syslog_priority", "syslog_facility", "syslog_severity")]
    return events.select("event_id", "source", "message", "n_lines", "level", *tags, "extra.raw_line")


JSON_MATCHED = f"""SELECT source, line_no, line, CAST({SECONDS_SQL} AS DOUBLE) AS ts, strlen(line) AS n_bytes
  FROM lines WHERE event_type IN ('error', 'signup')"""


@add("json_events", batch_sql(3600, 1000, 262144, JSON_MATCHED, "json") + """
SELECT b.source, batch_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS level, event_type AS msg, user_id
FROM b JOIN events ON event_id = first_line_no""")
def json_events(spark, sf):
    detector = detector_for("json", "level:error|warn")
    found = matched_lines(lines(spark, sf, "json"), detector)
    events = E.build_events(B.group_batches(found, window=HOUR), detector)
    data = F.col("contexts.log_data")
    return events.select(
        "source", "batch_id", "level", F.get_json_object(data, "$.msg").alias("msg"),
        F.get_json_object(data, "$.user_id").cast("bigint").alias("user_id"),
    )


@add("event_payload_json", f"""
WITH {lines_sql('syslog')}, k AS (SELECT source, CAST(user_id AS VARCHAR) AS ts_key, line_no, line FROM lines WHERE event_type = 'error')
SELECT source, ts_key, 'Log errors at timestamp [' || ts_key || ']' AS message, 'error' AS level, 'staging' AS environment,
  count(*) AS line_count, string_agg(line, chr(10) ORDER BY line_no) AS lines FROM k GROUP BY source, ts_key""")
def event_payload_json(spark, sf):
    found = matched_lines(lines(spark, sf, "syslog"), generic_detector("error$"), as_of=1706745600.0)
    body = E.payload_json(B.group_by_timestamp(found), environment="staging")
    get = lambda path: F.get_json_object("payload", path)
    return body.select(
        "source", "ts_key", get("$.message").alias("message"), get("$.level").alias("level"),
        get("$.environment").alias("environment"), get("$.extra.log_lines.line_count").cast("bigint").alias("line_count"),
        get("$.extra.log_lines.lines").alias("lines"),
    )


@add("source_metrics", f"""
WITH RECURSIVE {lines_sql('nginx')}, {anchored_sql(NGINX_MATCHED + " AND user_id % 10 <> 1", 3600, 1000, 262144)},
b AS (SELECT source, batch_id, min(start_ts) AS start_ts FROM walk GROUP BY ALL),
{windows_sql("SELECT source, batch_id AS ord, start_ts AS t FROM b", 21600)},
c AS (SELECT source, count(*) AS processed_lines, count(*) FILTER ({NGINX_SQL}) AS matched,
  count(*) FILTER ({NGINX_SQL} AND user_id % 10 = 1) AS excluded, count(*) FILTER ({NGINX_SQL} AND user_id % 10 <> 1) AS issues_detected
  FROM lines GROUP BY source),
v AS (SELECT source, count(*) AS events, count(*) FILTER (pos < 2) AS events_sent, count(*) FILTER (pos >= 2) AS events_dropped FROM lim GROUP BY source)
SELECT * FROM c JOIN v USING (source)""")
def source_metrics_query(spark, sf):
    raw = lines(spark, sf, "nginx")
    detector, exclude = detector_for("nginx"), r"1#0: "
    marked = mark_excluded(mark_detected(raw, detector), exclude)
    batches = B.group_batches(matched_lines(raw, detector, exclude), window=HOUR).select("source", "batch_id", "start_ts")
    return source_metrics(marked, L.rate_limit(batches, burst=2, window=6 * HOUR))


METRIC_ROWS_SQL = " UNION ALL ".join(
    f"SELECT source, '{metric}' AS metric, '{status}' AS status, CAST({column} AS DOUBLE) AS value FROM wide"
    for metric, status, column in (
        ("processed_lines_total", "", "processed_lines"), ("issues_detected_total", "", "issues_detected"),
        ("events_total", "sent", "events_sent"), ("events_total", "dropped", "events_dropped"),
    )
)


@add("metrics_rows", CATALOG.sql["source_metrics"].replace("SELECT * FROM c JOIN v USING (source)", f""",
wide AS (SELECT * FROM c JOIN v USING (source)) {METRIC_ROWS_SQL}"""))
def metrics_rows_query(spark, sf):
    return metrics_rows(source_metrics_query(spark, sf))


QUIET_MATCHED = f"""SELECT 'src' || (user_id % 4) AS source, event_id AS line_no, CAST({SECONDS_SQL} AS DOUBLE) AS ts,
  CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS line, strlen(CASE WHEN event_type = 'view' THEN '' ELSE event_type END) AS n_bytes FROM events"""


@add("sendable_batches", batch_sql(300, 1000, 262144, QUIET_MATCHED) + """
SELECT source, batch_id, message FROM b WHERE message <> '' OR last_line_no = (SELECT max(last_line_no) FROM b x WHERE x.source = b.source)""")
def sendable_batches(spark, sf):
    quiet = lines(spark, sf, "iso", "ts", "event_type").select(
        "source", "line_no", epoch_seconds().cast("double").alias("ts"), F.lit("").alias("ts_str"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("line"),
    ).withColumn("n_bytes", F.octet_length("line").cast("long"))
    return B.sendable(B.group_batches(quiet, window=300.0), quiet).select("source", "batch_id", "message")


@add("last_activity", """
SELECT 'src' || (user_id % 4) AS source, max(ts) AS last_activity FROM events GROUP BY 1""")
def last_activity_query(spark, sf):
    return last_activity(lines(spark, sf, "iso", "ts"), clock="ts")


MONITORS_SQL = """mons AS (SELECT 'm' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'https://k@h/' || c_custkey END AS dsn,
  CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS environment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'r' || c_nationkey END AS release FROM customer)"""


def monitor_table(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("m"), key.cast("string")).alias("name"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("https://k@h/"), key.cast("string"))).alias("dsn"),
        F.when(key % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("environment"),
        F.when(key % 5 != 0, F.concat(F.lit("r"), F.col("c_nationkey").cast("string"))).alias("release"),
    )


@add("tenant_routing", f"""
WITH {MONITORS_SQL}
SELECT o_orderkey, 'm' || o_custkey AS monitor,
  CASE WHEN coalesce(dsn, '') <> '' THEN dsn ELSE 'https://g@h/0' END AS dsn,
  CASE WHEN coalesce(dsn, '') <> '' AND coalesce(environment, '') <> '' THEN environment ELSE 'production' END AS environment,
  CASE WHEN coalesce(dsn, '') <> '' AND coalesce(release, '') <> '' THEN release ELSE 'v1' END AS release
FROM orders LEFT JOIN mons ON mons.name = 'm' || o_custkey""")
def tenant_routing(spark, sf):
    events = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("monitor")
    )
    return E.route(events, monitor_table(spark, sf), "https://g@h/0", "production", "v1")


@add("event_sink", """
SELECT CASE WHEN c_nationkey % 3 = 0 THEN 'h_0' ELSE 'h_' || c_nationkey END AS tenant, count(*) AS n, sum(c_custkey) AS total
FROM customer GROUP BY 1""")
def event_sink(spark, sf):
    nation = F.col("n_nationkey").cast("string")
    monitors = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), nation).alias("name"), F.lit("").alias("environment"), F.lit("").alias("release"),
        F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("https://k@h/"), nation)).alias("dsn"),
    )
    events = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("monitor")
    )
    path = new_path(spark, "events")
    write_events(E.route(events, monitors, "https://g@h/0"), path)
    return read_events(spark, path).groupBy(F.col("tenant").cast("string").alias("tenant")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total")
    )


@add("retry_dlq", """
SELECT DISTINCT sha256(CAST(event_id AS VARCHAR)) AS event_id, CAST(event_id AS VARCHAR) AS payload FROM events
WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE user_id % 3 = 0)""")
def retry_dlq(spark, sf):
    events = table(spark, sf, "events")
    key = F.sha2(F.col("event_id").cast("string"), 256).alias("event_id")
    payload = F.col("event_id").cast("string").alias("payload")
    letters = events.filter("event_type = 'error'").select(key, payload)
    twice = letters.unionByName(letters)
    return pending(twice, events.filter("user_id % 3 = 0").select(key))


FLOW_TENANT = {"dsn": "https://g@h/0", "environment": "live", "release": ""}
FLOW_MONITORS = [
    {"name": "src0", "format": "nginx", "dsn": "https://a@h/1", "rate_limit_burst": 1, "rate_limit_window": "1h"},
    {"name": "src1", "format": "nginx", "exclude_pattern": "1#0"},
    {"name": "src2", "pattern": "signup"},
    {"name": "src3", "format": "nginx-error", "environment": "ignored"},
]


@add("whole_flow", f"""
WITH RECURSIVE {lines_sql('nginx')}, {anchored_sql(
    f"SELECT source, line_no, line, CAST({SECONDS_SQL} AS DOUBLE) AS ts, strlen(line) AS n_bytes FROM lines WHERE "
    f"CASE source WHEN 'src2' THEN event_type = 'signup' WHEN 'src1' THEN {NGINX_SQL} AND NOT contains(line, '1#0') ELSE {NGINX_SQL} END",
    5, 1000, 262144)},
b AS (SELECT source, batch_id, min(start_ts) AS start_ts FROM walk GROUP BY ALL),
{windows_sql("SELECT source, batch_id AS ord, start_ts AS t FROM b", 3600)}
SELECT lim.source, lim.ord AS batch_id, CASE WHEN lim.source = 'src0' THEN 'https://a@h/1' ELSE 'https://g@h/0' END AS dsn,
  'live' AS environment, lim.source <> 'src0' OR pos < 1 AS passed, CAST(start_ts AS BIGINT) AS start_ts
FROM lim JOIN b ON b.source = lim.source AND b.batch_id = lim.ord""")
def whole_flow(spark, sf):
    raw = lines(spark, sf, "nginx").withColumn("monitor", F.col("source"))
    events = issues_to_events(raw, FLOW_TENANT, FLOW_MONITORS)
    return events.select(
        "source", "batch_id", "dsn", "environment", "passed", F.col("start_ts").cast("bigint").alias("start_ts")
    )
