"""Tables and line fixtures shared by the registered queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.fixtures import event_lines
from emberline.session import configure

LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END"
SECONDS_SQL = "date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts))"
UPTIME_SQL = f"({SECONDS_SQL} - 1704067200)"

LINE_SQL = {
    "iso": "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' user=' || user_id",
    "nginx": f"strftime(ts, '%Y/%m/%d %H:%M:%S') || ' [' || {LEVEL_SQL} || '] ' || user_id || '#0: *' || event_id"
             " || ' ' || event_type",
    "access": "'10.0.0.' || (user_id % 256) || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] \"GET /'"
              " || event_type || '\"'",
    "syslog": "'<' || CASE WHEN event_type = 'error' THEN '11' ELSE '14' END || '>'"
              " || strftime(ts, '%b %d %H:%M:%S') || ' host app[' || user_id || ']: ' || event_type",
    "dmesg": f"CASE WHEN event_id % 10 = 9 THEN ' cont ' || event_id ELSE '[' || {UPTIME_SQL} || '.000000] dev'"
             " || (user_id % 3) || ': ' || event_type END",
    "json": f"'{{\"time\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z\",\"level\":\"' || {LEVEL_SQL}"
            " || '\",\"msg\":\"' || event_type || '\",\"user_id\":' || user_id || '}'",
}


def lines_sql(fmt: str, name: str = "lines") -> str:
    """A CTE with the same lines as ``lines``."""
    return (
        f"{name} AS (SELECT 'src' || (user_id % 4) AS source, event_id AS line_no, {LINE_SQL[fmt]} AS line, *"
        " FROM events)"
    )


#: Rows of one part at most, so that the longest task of a query does not grow with its table.
PART_ROWS = {"events": 1 << 16, "documents": 1 << 17}


def spread(df: DataFrame, most: int) -> DataFrame:
    """Use all cores, in parts of about ``most`` rows. A scan has as many parts as its files have bytes for, but the
    rows of a row group are all in one of them, so the rows of each part are counted (from the files' footers). A
    scan with rows in as many parts as there are cores, and not too many in any, is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    parts, largest, rows = found.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    return df if parts >= cores and largest <= most else df.repartition(max(cores, -(-(rows or 0) // most)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, PART_ROWS[name]) if name in PART_ROWS else df


def lines(spark: SparkSession, sf_dir: str, fmt: str, *keep: str) -> DataFrame:
    return event_lines(table(spark, sf_dir, "events"), fmt, *keep)


def anchored_sql(matched: str, window: float, max_lines: int, max_bytes: int) -> str:
    """CTEs from ``matched(source, line_no, line, ts, n_bytes)`` to ``walk``: each line
    with the number ``batch_id`` of its batch's first line, one line after the other."""
    fresh = f"(w.cnt >= {max_lines} OR w.size + m.n_bytes >= {max_bytes} OR (m.ts <> 0 AND m.ts - w.start_ts > {window}))"
    return f"""
    m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) - 1 AS rn FROM ({matched})),
    walk AS (
      SELECT source, rn, line_no, ts AS start_ts, CAST(1 AS BIGINT) AS cnt, CAST(n_bytes AS BIGINT) AS size,
             rn AS batch_id
      FROM m WHERE rn = 0
      UNION ALL
      SELECT m.source, m.rn, m.line_no,
             CASE WHEN {fresh} THEN m.ts ELSE w.start_ts END,
             CASE WHEN {fresh} THEN 1 ELSE w.cnt + 1 END,
             CASE WHEN {fresh} THEN m.n_bytes ELSE w.size + 1 + m.n_bytes END,
             CASE WHEN {fresh} THEN m.rn ELSE w.batch_id END
      FROM walk w JOIN m ON m.source = w.source AND m.rn = w.rn + 1
    )"""


def windows_sql(events: str, window: float) -> str:
    """CTEs from ``events(source, ord, t)`` to ``lim``: each event with the first time
    of its limiter window, one event after the other."""
    return f"""
    e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS rn FROM ({events})),
    lim AS (
      SELECT source, ord, rn, t AS since, CAST(0 AS BIGINT) AS pos FROM e WHERE rn = 0
      UNION ALL
      SELECT e.source, e.ord, e.rn,
             CASE WHEN e.t - l.since > {window} THEN e.t ELSE l.since END,
             CASE WHEN e.t - l.since > {window} THEN 0 ELSE l.pos + 1 END
      FROM lim l JOIN e ON e.source = l.source AND e.rn = l.rn + 1
    )"""
