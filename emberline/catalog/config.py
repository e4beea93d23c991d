"""Monitor configuration over tables of monitors."""

from pyspark.sql import functions as F

from emberline.catalog import Catalog
from emberline.catalog.common import table
from emberline.operators import monitors as M

CATALOG = Catalog()
add = CATALOG.add

CHOICES = {
    "name": ["", "nginx", "json", "web", "dmesg", "nginx-error", "app"],
    "type": ["file", "dmesg", "command", "syslog", "other", "journalctl"],
    "path": ["", "/var/log/x", "/srv/y", "/srv/z", "/w"],
    "args": ["", "--password=x run", "-f --token abc", "ls -l"],
    "pattern": ["", "(", "error", "", "a[b"],
    "format": ["", "", "", "nginx", "json", "", "", "", ""],
    "exclude_pattern": ["", "ok", "", "[", "x*", "", "", "", "", "", ""],
    "max_inactivity": ["", "5m", "1h30m", "soon", "", "", "", "", "", "", "", "", ""],
    "rate_limit_window": ["", "1s", "2days", "", "", "", "", "", "", "", "", "", "", "", "", "", ""],
    "dsn": ["", "https://k@h/1"],
}
SOURCE = "orders"
KEY = "o_orderkey"


def monitors(spark, sf):
    picks = [
        F.element_at(F.array(*map(F.lit, values)), (F.col(KEY) % len(values) + 1).cast("int")).alias(name)
        for name, values in CHOICES.items()
    ]
    return table(spark, sf, SOURCE).select(KEY, *picks)


def _pick(name: str) -> str:
    values = ", ".join(f"'{v}'" for v in CHOICES[name])
    return f"([{values}])[{KEY} % {len(CHOICES[name])} + 1] AS {name}"


MONITORS_SQL = f"mons AS (SELECT {KEY}, {', '.join(map(_pick, CHOICES))} FROM {SOURCE})"


def format_sql(by_name: bool) -> str:
    rule = "WHEN name IN ('dmesg', 'nginx', 'nginx-error', 'json') THEN name" if by_name else ""
    return f"""WITH {MONITORS_SQL} SELECT {KEY}, CASE WHEN format <> '' THEN format WHEN pattern <> '' THEN 'custom'
      WHEN type = 'dmesg' THEN 'dmesg' {rule} ELSE 'custom' END AS chosen FROM mons"""


@add("infer_format", format_sql(True))
def infer_format(spark, sf):
    return monitors(spark, sf).select(KEY, M.infer_format().alias("chosen"))


@add("infer_format_without_name", format_sql(False))
def infer_format_without_name(spark, sf):
    return monitors(spark, sf).select(KEY, M.infer_format(by_name=False).alias("chosen"))


@add("validate_monitors", f"""
WITH {MONITORS_SQL} SELECT * FROM (SELECT {KEY}, CASE WHEN name = '' THEN 'a monitor without a name'
  WHEN type = 'other' THEN 'no such monitor type: other' WHEN type = 'file' AND path = '' THEN 'a file monitor without a path'
  WHEN type = 'command' AND args = '' THEN 'a command monitor without a command' WHEN pattern IN ('(', 'a[b') THEN 'pattern cannot be read'
  WHEN exclude_pattern = '[' THEN 'exclude_pattern cannot be read' WHEN max_inactivity = 'soon' THEN 'max_inactivity is no duration'
  WHEN rate_limit_window = '2days' THEN 'rate_limit_window is no duration' END AS error FROM mons) WHERE error IS NOT NULL""")
def validate_monitors(spark, sf):
    return monitors(spark, sf).select(KEY, M.validation_error().alias("error")).filter("error IS NOT NULL")


@add("redact_monitors", f"""
WITH {MONITORS_SQL} SELECT {KEY}, CASE WHEN dsn <> '' THEN '***' ELSE '' END AS dsn, CASE args WHEN '--password=x run' THEN '--password=[REDACTED] run'
  WHEN '-f --token abc' THEN '-f --token [REDACTED]' ELSE args END AS args FROM mons""")
def redact_monitors(spark, sf):
    return M.redact_monitors(monitors(spark, sf)).select(KEY, "dsn", "args")


@add("merge_fallback", f"""
WITH {MONITORS_SQL} SELECT {KEY}, CASE WHEN dsn = '' THEN 'https://g@h/0' ELSE dsn END AS dsn FROM mons""")
def merge_fallback(spark, sf):
    return monitors(spark, sf).select(KEY, M.merge_fallback("dsn", "https://g@h/0").alias("dsn"))
