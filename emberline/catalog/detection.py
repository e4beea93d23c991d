"""Detectors, exclusion, kernel context and monitors."""

from pyspark.sql import functions as F

from emberline.catalog import Catalog
from emberline.catalog.common import SECONDS_SQL, UPTIME_SQL, lines, lines_sql, table
from emberline.functions.basics import bind
from emberline.functions.jsonlines import go_value_string, is_json_object, json_object
from emberline.functions.kernel import dmesg_header, headers_related, strip_dmesg_timestamp
from emberline.operators import detect as D
from emberline.operators.metrics import line_counts

CATALOG = Catalog()
add = CATALOG.add

MIXED_PATTERN = r"(error|signup).* user=1\d*$"
SECRET_PATTERN = r'(?i)(token|password|secret|api_key)\s*[=:]\s*"?[0-9a-z]{8,}'
NGINX_SQL = "regexp_matches(line, '(?i)(error|critical|crit|alert|emerg)')"
DMESG_SQL = "regexp_matches(line, '(?i)(error|fail|panic|oops|exception)')"


@add("detect_regex", f"WITH {lines_sql('iso')} SELECT source, line_no FROM lines WHERE regexp_matches(line, '{MIXED_PATTERN}')")
def detect_regex(spark, sf):
    df = lines(spark, sf, "iso")
    return df.filter(D.detect_generic("line", MIXED_PATTERN)).select("source", "line_no")


@add("detect_literal", f"WITH {lines_sql('iso')} SELECT source, line_no FROM lines WHERE contains(line, 'purchase user=7')")
def detect_literal(spark, sf):
    return lines(spark, sf, "iso").filter(D.detect_generic("line", "purchase user=7")).select("source", "line_no")


@add("detect_contains_ci", "SELECT doc_id FROM documents WHERE contains(lower(text), 'token')")
def detect_contains_ci(spark, sf):
    return table(spark, sf, "documents").filter(D.detect_contains_ci("text", "TOKEN")).select("doc_id")


@add("detect_document_secrets", f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '{SECRET_PATTERN}')")
def detect_document_secrets(spark, sf):
    return table(spark, sf, "documents").filter(D.detect_generic("text", SECRET_PATTERN)).select("doc_id", "lang")


@add("detect_nginx", f"WITH {lines_sql('nginx')} SELECT source, line_no, line FROM lines WHERE {NGINX_SQL}")
def detect_nginx(spark, sf):
    marked = D.mark_detected(lines(spark, sf, "nginx"), D.detector_for("nginx"))
    return marked.filter("detected").select("source", "line_no", "line")


@add("detect_nginx_error", f"""
WITH {lines_sql('nginx')} SELECT source, line_no, CAST({SECONDS_SQL} AS BIGINT) AS ts FROM lines WHERE {NGINX_SQL}""")
def detect_nginx_error(spark, sf):
    found = D.matched_lines(lines(spark, sf, "nginx"), D.detector_for("nginx-error"))
    return found.select("source", "line_no", F.col("ts").cast("bigint").alias("ts"))


@add("exclude_pattern", f"""
WITH {lines_sql('nginx')} SELECT source, line_no FROM lines WHERE {NGINX_SQL} AND NOT regexp_matches(line, '\\*\\d*[05] ')""")
def exclude_pattern(spark, sf):
    found = D.matched_lines(lines(spark, sf, "nginx"), D.detector_for("nginx"), exclude=r"\*\d*[05] ")
    return found.select("source", "line_no")


@add("detect_json_field", f"""
WITH {lines_sql('json')} SELECT source, line_no FROM lines WHERE regexp_matches(json_extract_string(line, '$.level'), '^(error|warn)$')""")
def detect_json_field(spark, sf):
    return lines(spark, sf, "json").filter(D.detect_json("line", "level: ^(error|warn)$")).select("source", "line_no")


@add("detect_json_number", f"""
WITH {lines_sql('json')} SELECT source, line_no FROM lines WHERE regexp_matches(json_extract_string(line, '$.user_id'), '^1\\d$')""")
def detect_json_number(spark, sf):
    return lines(spark, sf, "json").filter(D.detect_json("line", r"user_id:^1\d$")).select("source", "line_no")


@add("detect_json_substring", f"""
WITH {lines_sql('json')} SELECT source, line_no FROM lines WHERE contains(lower(json_extract_string(line, '$.msg')), 'cli')""")
def detect_json_substring(spark, sf):
    return lines(spark, sf, "json").filter(D.detect_json_substring("line", "msg:CLI")).select("source", "line_no")


@add("json_gate", """
SELECT event_id, event_id % 5 IN (0, 4) AS valid FROM events""")
def json_gate(spark, sf):
    n = F.col("event_id") % 5
    line = (
        F.when(n == 0, F.col("props")).when(n == 1, F.concat("props", F.lit(" junk")))
        .when(n == 2, F.concat(F.lit("["), "props", F.lit("]"))).when(n == 3, F.expr("substring(props, 1, length(props) - 1)"))
        .otherwise(F.concat(F.lit("  "), "props", F.lit(" ")))
    )
    return table(spark, sf, "events").select("event_id", is_json_object(line).alias("valid"))


@add("json_value_text", """
SELECT event_id, CASE WHEN event_id * 977 < 1000000 THEN CAST(event_id * 977 AS VARCHAR)
  ELSE d[1] || CASE WHEN rtrim(d[2:], '0') = '' THEN '' ELSE '.' || rtrim(d[2:], '0') END || 'e+' || lpad(CAST(length(d) - 1 AS VARCHAR), 2, '0') END AS value_text
FROM (SELECT event_id, CAST(event_id * 977 AS VARCHAR) AS d FROM events)""")
def json_value_text(spark, sf):
    line = F.concat(F.lit('{"n":'), (F.col("event_id") * 977).cast("string"), F.lit("}"))
    return table(spark, sf, "events").select(
        "event_id", bind(json_object(line), lambda o: go_value_string(o, "n")).alias("value_text")
    )


@add("dmesg_header", f"""
WITH {lines_sql('dmesg')} SELECT line_no, CASE WHEN event_id % 10 <> 9 THEN 'dev' || (user_id % 3) END AS header FROM lines""")
def dmesg_header_query(spark, sf):
    return lines(spark, sf, "dmesg").select("line_no", dmesg_header("line").alias("header"))


@add("dmesg_transform", f"""
WITH {lines_sql('dmesg')} SELECT line_no, CASE WHEN event_id % 10 = 9 THEN line ELSE 'dev' || (user_id % 3) || ': ' || event_type END AS message FROM lines""")
def dmesg_transform(spark, sf):
    return lines(spark, sf, "dmesg").select("line_no", strip_dmesg_timestamp("line").alias("message"))


@add("headers_related", """
SELECT event_id, starts_with('ata' || user_id, 'ata' || (event_id % 20)) OR starts_with('ata' || (event_id % 20), 'ata' || user_id) AS related FROM events""")
def headers_related_query(spark, sf):
    a = F.concat(F.lit("ata"), F.col("user_id").cast("string"), F.lit(" "))
    b = F.concat(F.lit(" ata"), (F.col("event_id") % 20).cast("string"))
    return table(spark, sf, "events").select("event_id", headers_related(a, b).alias("related"))


DMESG_CONTEXT_SQL = f"""
WITH {lines_sql('dmesg')},
p AS (SELECT source, line_no, line, {DMESG_SQL} AS err, event_id % 10 <> 9 AS stamped,
      CASE WHEN event_id % 10 <> 9 THEN {UPTIME_SQL} ELSE 0 END AS t,
      CASE WHEN event_id % 10 <> 9 THEN 'dev' || (user_id % 3) END AS hdr FROM lines),
s AS (SELECT *, last_value(CASE WHEN err AND t > 0 THEN t END IGNORE NULLS) OVER w AS last_t,
      last_value(CASE WHEN err THEN hdr END IGNORE NULLS) OVER w AS last_hdr
      FROM p WINDOW w AS (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, line_no, line FROM s
WHERE err OR (last_hdr IS NOT NULL AND (NOT stamped OR (t > 0 AND t - coalesce(last_t, 0) <= 5
      AND (starts_with(last_hdr, hdr) OR starts_with(hdr, last_hdr)))))"""


@add("dmesg_context", DMESG_CONTEXT_SQL)
def dmesg_context(spark, sf):
    marked = D.mark_detected(lines(spark, sf, "dmesg"), D.detector_for("dmesg"))
    return marked.filter("detected").select("source", "line_no", "line")


@add("funnel", f"""
WITH {lines_sql('nginx')}, f AS (SELECT source, {NGINX_SQL} AS d, regexp_matches(line, ' error$') AND user_id % 10 = 1 AS x FROM lines)
SELECT source, count(*) AS processed_lines, count(*) FILTER (d) AS matched, count(*) FILTER (d AND x) AS excluded,
  count(*) FILTER (d AND NOT x) AS issues_detected FROM f GROUP BY source""")
def funnel(spark, sf):
    marked = D.mark_detected(lines(spark, sf, "nginx"), D.detector_for("nginx"))
    return line_counts(D.mark_excluded(marked, r"1#0: .* error$"))


MONITORS = [
    {"name": "web", "format": "nginx", "exclude_pattern": "7#0"},
    {"name": "api", "pattern": "level:^error$", "format": "json"},
    {"name": "app", "pattern": "signup"},
    {"name": "dmesg", "type": "dmesg"},
]


@add("detect_all", f"""
WITH {lines_sql('nginx', 'w')}, {lines_sql('json', 'j')}, {lines_sql('iso', 'i')}
SELECT 'web' AS monitor, source, line_no, {SECONDS_SQL} AS ts FROM w WHERE {NGINX_SQL} AND NOT contains(line, '7#0')
UNION ALL SELECT 'api', source, line_no, {SECONDS_SQL} FROM j WHERE event_type = 'error'
UNION ALL SELECT 'app', source, line_no, {SECONDS_SQL} FROM i WHERE event_type = 'signup'
UNION ALL SELECT 'dmesg', d.source, d.line_no, CASE WHEN event_id % 10 = 9 THEN 0 ELSE {UPTIME_SQL} END
FROM ({DMESG_CONTEXT_SQL}) d JOIN events ON event_id = d.line_no""")
def detect_all(spark, sf):
    every = None
    for name, fmt in (("web", "nginx"), ("api", "json"), ("app", "iso"), ("dmesg", "dmesg")):
        part = lines(spark, sf, fmt).withColumn("monitor", F.lit(name))
        every = part if every is None else every.unionByName(part)
    found = D.detect_all(every, MONITORS)
    return found.select("monitor", "source", "line_no", F.col("ts").cast("bigint").alias("ts"))
