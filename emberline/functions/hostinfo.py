"""Parsing of host statistics text, and the percentages derived from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.basics import as_col, bind, found

# Default clock ticks per second and page size, field positions of
# the process status line counted after the closing parenthesis.
CLOCK_TICKS = 100.0
PAGE_SIZE = 4096
STAT_FIELDS = {"utime": 12, "stime": 13, "starttime": 20, "rss": 22}
PRESSURE_KEYS = ("avg10", "avg60", "avg300", "total")


def parse_psi(text) -> Column:
    """``STRUCT<avg10, avg60, avg300, total>`` of the first line starting ``some``."""
    line = F.regexp_extract(as_col(text), r"(?:^|\n)(some[^\n]*)", 1)

    def value(s: Column, key: str) -> Column:
        return F.coalesce(
            F.regexp_extract(s, rf"(?:^|.*\s){key}=([^=\s]*)(?=\s|$)", 1).try_cast("double"), F.lit(0.0)
        )

    return bind(
        line, lambda s: F.when(s != "", F.struct(*[value(s, k).alias(k) for k in PRESSURE_KEYS]))
    )


def parse_proc_stat(text) -> Column:
    """``STRUCT<utime, stime, starttime, rss>``; the command name may hold blanks
    and parentheses, so fields are counted from the last ``)``."""
    t = as_col(text)
    fields = F.split(F.trim(F.substring_index(t, ")", -1)), " +")
    return bind(
        fields,
        lambda f: F.when(
            F.contains(t, F.lit(")")) & (F.size(f) >= max(STAT_FIELDS.values())),
            F.struct(*[
                F.coalesce(F.try_element_at(f, F.lit(i)).try_cast("double").cast("long"), F.lit(0)).alias(n)
                for n, i in STAT_FIELDS.items()
            ]),
        ),
    )


def parse_meminfo(text) -> Column:
    """``STRUCT<total, available, used, used_percent>`` in bytes."""
    t = as_col(text)
    kib = lambda k: F.coalesce(found(t, rf"(?:^|\n){k}: *([0-9]+)", 1).cast("long"), F.lit(0)) * 1024
    return bind(
        F.struct(kib("MemTotal").alias("t"), kib("MemAvailable").alias("a")),
        lambda s: F.when(
            s["t"] > 0,
            F.struct(
                s["t"].alias("total"),
                s["a"].alias("available"),
                (s["t"] - s["a"]).alias("used"),
                ((s["t"] - s["a"]).cast("double") / s["t"].cast("double") * 100.0).alias("used_percent"),
            ),
        ),
    )


def parse_loadavg(text) -> Column:
    parts = F.split(F.trim(as_col(text)), "\\s+")
    return F.struct(*[
        F.try_element_at(parts, F.lit(i)).try_cast("double").alias(n)
        for i, n in enumerate(("load1", "load5", "load15"), start=1)
    ])


def parse_uptime(text) -> Column:
    return F.floor(F.substring_index(F.trim(as_col(text)), " ", 1).try_cast("double"))


def cpu_percent(utime, stime, starttime, uptime, clock_ticks: float = CLOCK_TICKS) -> Column:
    """Average share of one CPU since the process began; 0 when it has no age."""
    ticks = (as_col(utime) + as_col(stime)).cast("double")
    age = as_col(uptime).cast("double") - as_col(starttime).cast("double") / clock_ticks
    return F.when(age > 0, ticks / clock_ticks / age * 100.0).otherwise(0.0)


def rss_bytes(rss_pages, page_size: int = PAGE_SIZE) -> Column:
    return as_col(rss_pages) * page_size


def mem_percent(rss_pages, total_mem, page_size: int = PAGE_SIZE) -> Column:
    total = as_col(total_mem)
    return F.when(
        total > 0, rss_bytes(rss_pages, page_size).cast("double") / total.cast("double") * 100.0
    ).otherwise(0.0)
