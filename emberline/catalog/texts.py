"""Redaction, formatting, parsing, payload framing and text files."""

from pyspark.sql import functions as F

from emberline.catalog import Catalog
from emberline.catalog.common import LINE_SQL, lines, table
from emberline.functions import redact as R
from emberline.functions import text as X
from emberline.functions.jsonlines import json_escape
from emberline.plans.storage import new_path
from emberline.sources.text import read_lines, split_payload

CATALOG = Catalog()
add = CATALOG.add

NAMES_SQL = "(?:password|token|secret|signature|credential|cookie|session)"
SENSITIVE_SQL = f"(?i)^(?:password|token|secret|key|auth|(?:.*[-_.])?{NAMES_SQL}|.*[-_.]key)$"
STRICT_SQL = "(?i)^--(?:password|token|api-key|apikey|secret|client-secret|access-token|auth-token|session-id)$"


def walk_sql(words: str) -> str:
    """Redaction of ``words(id, i, w)`` by runs of flags: within a run of flag words
    every second one is itself a hidden value."""
    return f"""
t AS (SELECT *, lead(w) OVER (PARTITION BY id ORDER BY i) AS nxt, contains(w, '=') AS eq FROM ({words})),
f AS (SELECT *, NOT eq AND (regexp_matches(w, '{STRICT_SQL}') OR (regexp_matches(ltrim(w, '-'), '{SENSITIVE_SQL}')
        AND nxt IS NOT NULL AND NOT starts_with(nxt, '-'))) AS flag,
      eq AND (regexp_matches(ltrim(split_part(w, '=', 1), '-'), '{SENSITIVE_SQL}') OR regexp_matches(split_part(w, '=', 1), '{STRICT_SQL}')) AS hide
      FROM t),
g AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS run FROM f),
r AS (SELECT *, CASE WHEN flag THEN row_number() OVER (PARTITION BY id, run, flag ORDER BY i) END AS pos FROM g),
h AS (SELECT *, coalesce(lag(CASE WHEN flag THEN pos % 2 = 1 ELSE FALSE END) OVER (PARTITION BY id ORDER BY i), FALSE) AS hidden FROM r)
SELECT id, string_agg(CASE WHEN hidden THEN '[REDACTED]' WHEN hide THEN split_part(w, '=', 1) || '=[REDACTED]' ELSE w END, ' ' ORDER BY i) AS command
FROM h GROUP BY id"""


DOCUMENT_WORDS_SQL = """SELECT doc_id AS id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
  FROM (SELECT doc_id, [x for x in regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+') if x <> ''] AS ws FROM documents)"""


@add("sanitize_documents", f"WITH {walk_sql(DOCUMENT_WORDS_SQL)}")
def sanitize_documents(spark, sf):
    words = F.filter(F.split("text", "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")
    docs = table(spark, sf, "documents").filter(F.col("text").rlike("[^ \\t\\n\\x0b\\f\\r]"))
    return docs.select(F.col("doc_id").alias("id"), R.sanitize_command(words).alias("command"))


ARGS_SQL = """['run', CASE event_id % 7 WHEN 0 THEN '--token' WHEN 1 THEN 'db_password' WHEN 2 THEN '--my-key=' || user_id WHEN 3 THEN 'monkey'
    WHEN 4 THEN '--APIKEY' WHEN 5 THEN '-p' ELSE 'auth' END, CASE event_id % 5 WHEN 0 THEN '--secret' WHEN 1 THEN '-v' WHEN 2 THEN 'session'
    WHEN 3 THEN 'a=b' ELSE 'x' || user_id END, event_type, CASE event_id % 3 WHEN 0 THEN 'cookie' WHEN 1 THEN 'token=' || user_id ELSE '--x' END]"""
COMMAND_WORDS_SQL = f"""SELECT event_id AS id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT event_id, {ARGS_SQL} AS ws FROM events)"""


def arguments():
    user = F.col("user_id").cast("string")
    n = lambda m: F.col("event_id") % m
    return F.array(
        F.lit("run"),
        F.when(n(7) == 0, "--token").when(n(7) == 1, "db_password").when(n(7) == 2, F.concat(F.lit("--my-key="), user))
        .when(n(7) == 3, "monkey").when(n(7) == 4, "--APIKEY").when(n(7) == 5, "-p").otherwise("auth"),
        F.when(n(5) == 0, "--secret").when(n(5) == 1, "-v").when(n(5) == 2, "session").when(n(5) == 3, "a=b")
        .otherwise(F.concat(F.lit("x"), user)),
        "event_type",
        F.when(n(3) == 0, "cookie").when(n(3) == 1, F.concat(F.lit("token="), user)).otherwise("--x"),
    )


@add("sanitize_command", f"WITH {walk_sql(COMMAND_WORDS_SQL)}")
def sanitize_command(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), R.sanitize_command(arguments()).alias("command")
    )


@add("sanitize_loose", """
SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'mytoken=[REDACTED] x' WHEN 1 THEN '--token [REDACTED] db-password y'
  ELSE '--Token z' || user_id || ' --session-id q' END AS command FROM events""")
def sanitize_loose(spark, sf):
    user = F.col("user_id").cast("string")
    n = F.col("event_id") % 3
    args = (
        F.when(n == 0, F.array(F.concat(F.lit("mytoken="), user), F.lit("x")))
        .when(n == 1, F.array(F.lit("--token"), user, F.lit("db-password"), F.lit("y")))
        .otherwise(F.array(F.lit("--Token"), F.concat(F.lit("z"), user), F.lit("--session-id"), F.lit("q")))
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), R.sanitize_command(args, "loose").alias("command")
    )


@add("sensitive_names", f"""
SELECT event_id, regexp_matches(CASE event_id % 6 WHEN 0 THEN 'my' WHEN 1 THEN 'my-' WHEN 2 THEN 'a.' WHEN 3 THEN '_' WHEN 4 THEN '' ELSE 'KEY.' END ||
  CASE user_id % 7 WHEN 0 THEN 'password' WHEN 1 THEN 'Key' WHEN 2 THEN 'auth' WHEN 3 THEN 'session' WHEN 4 THEN 'tokens' WHEN 5 THEN 'SECRET' ELSE 'name' END,
  '{SENSITIVE_SQL}') AS sensitive FROM events""")
def sensitive_names(spark, sf):
    prefix = F.element_at(F.array(*map(F.lit, ["my", "my-", "a.", "_", "", "KEY."])), (F.col("event_id") % 6 + 1).cast("int"))
    word = F.element_at(
        F.array(*map(F.lit, ["password", "Key", "auth", "session", "tokens", "SECRET", "name"])),
        (F.col("user_id") % 7 + 1).cast("int"),
    )
    return table(spark, sf, "events").select("event_id", R.is_sensitive_key(F.concat(prefix, word)).alias("sensitive"))


@add("byte_length", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents")
def byte_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.byte_length("text").alias("n_bytes"))


@add("format_bytes", """
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0)
  ELSE printf('%.1f GiB', n / 1073741824.0) END AS shown FROM (SELECT doc_id, n_chars * (CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END) AS n FROM documents)""")
def format_bytes(spark, sf):
    unit = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 1024).otherwise(1048576)
    return table(spark, sf, "documents").select("doc_id", X.format_bytes(F.col("n_chars") * unit).alias("shown"))


@add("format_duration", """
SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm'
  WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's'
  WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS shown
FROM (SELECT event_id, event_id * (user_id + 1) AS s FROM events)""")
def format_duration(spark, sf):
    seconds = F.col("event_id") * (F.col("user_id") + 1)
    return table(spark, sf, "events").select("event_id", X.format_duration(seconds).alias("shown"))


@add("parse_duration", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id * 1000 WHEN 1 THEN user_id * 3600000 + 90000 WHEN 2 THEN -user_id END AS ms FROM events""")
def parse_duration(spark, sf):
    user, n = F.col("user_id").cast("string"), F.col("event_id") % 4
    text = (
        F.when(n == 0, F.concat(user, F.lit("s"))).when(n == 1, F.concat(user, F.lit("h1m30s")))
        .when(n == 2, F.concat(F.lit("-"), user, F.lit("ms"))).otherwise(F.concat(user, F.lit(" days")))
    )
    return table(spark, sf, "events").select(
        "event_id", F.round(X.parse_duration(text) * 1000).cast("bigint").alias("ms")
    )


@add("parse_size", """
SELECT event_id, user_id * (CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END) AS size FROM events""")
def parse_size(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ["", "KB", "mb", "GB"])), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.col("user_id").cast("string"), unit)
    return table(spark, sf, "events").select("event_id", X.parse_size(text).alias("size"))


@add("parse_dsn", """
SELECT page_id, 'k' || page_id AS public_key, h AS host, p AS project_id, 'https://' || h || '/api/' || p || '/store/' AS endpoint
FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS h, regexp_extract(regexp_extract(url, '://[^/]+([^?#]*)', 1), '([^/]*)$', 1) AS p FROM pages)""")
def parse_dsn(spark, sf):
    address = F.regexp_replace("url", "://", F.concat(F.lit("://k"), F.col("page_id").cast("string"), F.lit("@")))
    parsed = table(spark, sf, "pages").select("page_id", X.parse_dsn(address).alias("d"))
    return parsed.select("page_id", "d.*")


@add("json_escape", """
SELECT conv_id, turn, json_extract_string('{"t":"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r') || '"}', '$.t') AS back FROM conversations""")
def json_escape_query(spark, sf):
    escaped = F.concat(F.lit('{"t":"'), json_escape("text"), F.lit('"}'))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.get_json_object(escaped, "$.t").alias("back"))


@add("split_payload", """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line FROM s)
SELECT doc_id, doc_id * 1048576 + pos AS line_no, trim(line, chr(13)) AS line FROM u WHERE trim(line, chr(13)) <> ''""")
def split_payload_query(spark, sf):
    landed = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("seq"), F.col("text").alias("payload"))
    return split_payload(landed)


@add("text_files", f"""
SELECT 'src' || (user_id % 4) AS source, count(*) AS n, min({LINE_SQL['iso']}) AS first_line, max({LINE_SQL['iso']}) AS last_line FROM events GROUP BY 1""")
def text_files(spark, sf):
    raw = lines(spark, sf, "iso")
    path = new_path(spark, "text")
    (raw.repartitionByRange(4, "source", "line_no").sortWithinPartitions("source", "line_no")
     .select("source", F.concat("line", F.lit("\r")).alias("line")).write.partitionBy("source").text(path))
    read = read_lines(spark, f"{path}/source=*/*.txt", "app")
    named = read.withColumn("source", F.regexp_extract("source", r"^app:.*/source=([^/]+)/", 1))
    return named.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    )
