"""Host snapshots: process ranking, assembly and attachment to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.basics import fixed_point
from emberline.functions.hostinfo import CLOCK_TICKS, PAGE_SIZE, cpu_percent, mem_percent, rss_bytes
from emberline.functions.redact import sanitize_command
from emberline.plans.asof import asof_join

TOP_K = 5
SNAPSHOT = ["host", "snapshot_ts"]


def process_usage(samples: DataFrame, clock_ticks: float = CLOCK_TICKS, page_size: int = PAGE_SIZE) -> DataFrame:
    """Add ``rss_bytes``, ``cpu_usage`` and ``mem_usage`` to process samples."""
    return samples.withColumns({
        "rss_bytes": rss_bytes("rss_pages", page_size),
        "cpu_usage": cpu_percent("utime", "stime", "starttime", "uptime", clock_ticks),
        "mem_usage": mem_percent("rss_pages", "total_mem", page_size),
    })


def top_processes(usage: DataFrame, by: str, k: int = TOP_K, keys: list[str] = SNAPSHOT, tie: str = "pid") -> DataFrame:
    """The ``k`` highest rows per snapshot with their ``rank``; ties go to the lower ``tie``.

    Spark keeps only ``k`` rows per group on each side of the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(tie))
    return usage.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def command_text(cmdline="cmdline", comm="comm", mode: str = "strict") -> Column:
    """Redacted command line, else the short name, else ``unknown``."""
    args = F.col(cmdline)
    words = F.when(args.isNotNull() & (F.size(args) > 0), args).otherwise(
        F.array(F.coalesce(F.col(comm), F.lit("unknown")))
    )
    return sanitize_command(words, mode)


def process_rows(top: DataFrame) -> DataFrame:
    """Top rows as display strings. Commands are read only for these few rows."""
    return top.select(
        *SNAPSHOT, "rank",
        F.struct(
            F.col("pid").cast("string").alias("pid"),
            F.col("rss_bytes").cast("long").cast("string").alias("rss"),
            fixed_point(F.col("cpu_usage"), 1).alias("cpu"),
            fixed_point(F.col("mem_usage"), 1).alias("mem"),
            command_text().alias("command"),
        ).alias("process"),
    )


def process_summary(samples: DataFrame, keys: list[str] = SNAPSHOT) -> DataFrame:
    total = F.concat(F.lit("Total Processes: "), F.count(F.lit(1)).cast("string"))
    return samples.groupBy(*keys).agg(total.alias("process_summary"))


def snapshots(samples: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row per host and time: ``top_cpu``, ``top_mem`` (ordered arrays) and ``process_summary``."""
    usage = process_usage(samples)
    ranked = None
    for name, column in (("top_cpu", "cpu_usage"), ("top_mem", "mem_usage")):
        part = process_rows(top_processes(usage, column, k)).withColumn("list", F.lit(name))
        ranked = part if ranked is None else ranked.unionByName(part)

    def listed(name: str) -> Column:
        pairs = F.collect_list(F.when(F.col("list") == name, F.struct("rank", "process")))
        return F.transform(F.array_sort(pairs), lambda p: p["process"]).alias(name)

    lists = ranked.groupBy(*SNAPSHOT).agg(listed("top_cpu"), listed("top_mem"))
    return lists.join(process_summary(samples), SNAPSHOT)


def server_state(table: DataFrame, name: str = "server_state") -> DataFrame:
    """Snapshot columns packed into one struct beside ``host`` and ``snapshot_ts``."""
    rest = [c for c in table.columns if c not in SNAPSHOT]
    return table.select(*SNAPSHOT, F.struct(F.col("snapshot_ts").alias("timestamp"), *rest).alias(name))


def attach_server_state(events: DataFrame, states: DataFrame, time: str = "sent_ts", **plan) -> DataFrame:
    """Add ``server_state``: the host's latest snapshot at or before ``time`` (epoch seconds)."""
    side = states.withColumnRenamed("snapshot_ts", time)
    return asof_join(events, side, "host", time, "server_state", **plan)
