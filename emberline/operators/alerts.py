"""Alerts for sources that fall silent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import format_duration
from emberline.plans.ordered import LAST, running


def inactivity(
    lines: DataFrame, max_silence: float, clock: str = "ts", order: str = "line_no", as_of: float | None = None,
    spans: tuple[int, ...] | None = None,
) -> DataFrame:
    """``(source, alert_type, level, at, silence, message)``.

    Every read line counts as activity, issue or not. A gap longer than
    ``max_silence`` seconds raises one warning when the limit passes and one info
    when the next line comes; silence lasting until ``as_of`` raises the warning only.
    """
    seen = lines.select("source", F.col(order), F.col(clock).cast("double").alias("_at"))
    previous = running(seen, ["source"], order, {"_previous": (LAST, "_at")}, spans)
    gaps = previous.filter(F.col("_at") - F.col("_previous") > max_silence).select(
        "source", F.col("_previous").alias("since"), F.col("_at").alias("until")
    )
    if as_of is not None:
        tail = seen.groupBy("source").agg(F.max_by("_at", order).alias("since"))
        gaps = gaps.unionByName(
            tail.filter(F.lit(float(as_of)) - F.col("since") > max_silence).withColumn(
                "until", F.lit(None).cast("double")
            )
        )
    name = F.col("source").cast("string")
    limit = F.col("since") + F.lit(float(max_silence))
    silent = F.struct(
        F.lit("warning").alias("level"), limit.alias("at"), F.lit(float(max_silence)).alias("silence"),
        F.concat(name, F.lit(": Monitor source inactivity detected (silence for "),
                 format_duration(F.lit(float(max_silence))), F.lit(")")).alias("message"),
    )
    resumed = F.struct(
        F.lit("info").alias("level"), F.col("until").alias("at"), (F.col("until") - F.col("since")).alias("silence"),
        F.concat(name, F.lit(": Monitor source activity resumed")).alias("message"),
    )
    both = F.when(F.col("until").isNull(), F.array(silent)).otherwise(F.array(silent, resumed))
    return gaps.select("source", F.lit("inactivity").alias("alert_type"), F.inline(both))
