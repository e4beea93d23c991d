"""Counters per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_counts(marked: DataFrame) -> DataFrame:
    """``processed_lines``, ``matched``, ``excluded`` and ``issues_detected`` per source,
    from lines with ``detected`` and ``excluded``."""
    issue = F.col("detected") & ~F.col("excluded")
    return marked.groupBy("source").agg(
        F.count(F.lit(1)).alias("processed_lines"),
        F.count_if("detected").alias("matched"),
        F.count_if("excluded").alias("excluded"),
        F.count_if(issue).alias("issues_detected"),
    )


def event_counts(limited: DataFrame) -> DataFrame:
    """``events``, ``events_sent`` and ``events_dropped`` per source, from ``passed``."""
    return limited.groupBy("source").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("passed").alias("events_sent"),
        F.count_if(~F.col("passed")).alias("events_dropped"),
    )


def source_metrics(marked: DataFrame, limited: DataFrame) -> DataFrame:
    """All counters of a source in one row; both sides are aggregated before the join."""
    joined = line_counts(marked).join(event_counts(limited), "source", "full")
    counters = [c for c in joined.columns if c != "source"]
    return joined.fillna(0, counters)


def metrics_rows(wide: DataFrame) -> DataFrame:
    """The same as ``(source, metric, status, value)`` rows."""
    return wide.select(
        "source",
        F.inline(F.array(*[
            F.struct(F.lit(metric).alias("metric"), F.lit(status).alias("status"),
                     F.col(column).cast("double").alias("value"))
            for metric, status, column in (
                ("processed_lines_total", "", "processed_lines"),
                ("issues_detected_total", "", "issues_detected"),
                ("events_total", "sent", "events_sent"),
                ("events_total", "dropped", "events_dropped"),
            )
        ])),
    )


def last_activity(lines: DataFrame, clock: str = "ingest_ts") -> DataFrame:
    return lines.groupBy("source").agg(F.max(clock).alias("last_activity"))


# --- counted while a stream runs -------------------------------------------

LINE_COUNTERS = ("processed_lines", "matched", "excluded", "issues_detected")
EVENT_COUNTERS = ("events", "events_sent", "events_dropped")


def observed(df: DataFrame, name: str, ids: list[str], counters: dict[str, Column]) -> DataFrame:
    """The same rows; Spark counts them on the way, for each ``monitor`` of ``ids`` and each counter (a
    condition). The sums of a micro-batch come with its progress, so nothing is read twice."""
    own = lambda i, test: F.count_if((F.col("monitor") == i) & F.coalesce(test, F.lit(False)))
    return df.observe(name, *[own(i, test).alias(f"{counter}_{i}") for i in ids for counter, test in counters.items()])


def progress_counts(progress: list, names: dict[str, str]) -> dict[str, dict[str, int]]:
    """Sums per monitor name over the progress of some micro-batches; ``names`` gives the name of an id."""
    out: dict[str, dict[str, int]] = {}
    for step in progress:
        for row in step.observedMetrics.values():
            for field, value in row.asDict().items():
                counter, _, i = field.rpartition("_")
                counts = out.setdefault(names[i], dict.fromkeys(LINE_COUNTERS + EVENT_COUNTERS, 0))
                counts[counter] += value or 0
    return out
