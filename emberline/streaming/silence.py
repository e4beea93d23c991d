"""Inactivity of streaming sources."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from emberline.operators.alerts import inactivity
from emberline.plans.kernels import one_row_per_source

LAST_SEEN = "source string, seen double"


class SilenceStream:
    """Inactivity by the clock in the lines: the same rows as the batch operator,
    one micro-batch at a time."""

    def __init__(self, spark: SparkSession, state: str, max_silence: float, clock: str = "ts"):
        self.spark, self.state = spark, state.rstrip("/")
        self.max_silence, self.clock = max_silence, clock

    def alerts(self, lines: DataFrame, epoch: int, as_of: float | None = None) -> DataFrame:
        path = f"{self.state}/seen/epoch="
        rows = lines.select("source", "line_no", F.col(self.clock).cast("double").alias("ts"))
        if epoch > 0:
            before = self.spark.read.schema(LAST_SEEN).parquet(f"{path}{epoch - 1}")
            rows = rows.unionByName(
                before.select("source", F.lit(-1).cast("long").alias("line_no"), F.col("seen").alias("ts"))
            )
        rows.groupBy("source").agg(F.max_by("ts", "line_no").alias("seen")).write.mode("overwrite").parquet(
            f"{path}{epoch}"
        )
        return inactivity(rows, self.max_silence, as_of=as_of)


def watch_inactivity(stream: DataFrame, max_silence: float) -> DataFrame:
    """Inactivity by the wall clock, with a timer per source: a warning once a source
    has been silent for ``max_silence`` seconds, an info when it speaks again.

    A busy source reaches the state as one row per task. Uses one boolean of state
    per source. Write with output mode ``append`` and a
    processing-time trigger.
    """
    names = stream.select("source").mapInPandas(one_row_per_source, "source string")

    def step(key, batches, state):
        (source,) = key
        alerted = bool(state.get[0]) if state.exists else False
        level = None
        if state.hasTimedOut:
            if not alerted:
                level, text = "warning", "Monitor source inactivity detected"
                state.update((True,))
        else:
            for _ in batches:
                pass
            if alerted:
                level, text = "info", "Monitor source activity resumed"
            state.update((False,))
            state.setTimeoutDuration(max(1, int(max_silence * 1000)))
        if level:
            yield pd.DataFrame({
                "source": [source], "alert_type": ["inactivity"], "level": [level], "at": [time.time()],
                "message": [f"{source}: {text}"],
            })

    return names.groupBy("source").applyInPandasWithState(
        step,
        "source string, alert_type string, level string, at double, message string",
        "alerted boolean",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
