"""Related kernel-log lines around an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.kernel import headers_related
from emberline.functions.timestamps import dmesg_seconds, dmesg_stamp
from emberline.plans.ordered import LAST, running

RELATED_SECONDS = 5.0


def kernel_parts(line: str, is_error) -> dict[str, Column]:
    """What a kernel line alone tells: ``error``, ``stamped``, ``at`` (seconds, 0 without) and ``header``."""
    stamp = dmesg_stamp(line)
    header = F.nullif(F.regexp_extract(line, r"^\[[^\]]*\] *([^:]*):", 1), F.lit(""))
    return {
        "error": F.coalesce(is_error(F.col(line)), F.lit(False)),
        "stamped": stamp.isNotNull(),
        "at": F.coalesce(dmesg_seconds(stamp), F.lit(0.0)),
        "header": F.when(stamp.isNotNull(), header),
    }


def _staged(lines: DataFrame, is_error) -> DataFrame:
    return (
        lines.withColumn("_error", F.coalesce(is_error(F.col("line")), F.lit(False)))
        .withColumn("_stamp", dmesg_stamp("line"))
        .withColumn("_ts", F.coalesce(dmesg_seconds(F.col("_stamp")), F.lit(0.0)))
        .withColumn(
            "_header",
            F.when(
                F.col("_stamp").isNotNull(),
                F.nullif(F.regexp_extract("line", r"^\[[^\]]*\] *([^:]*):", 1), F.lit("")),
            ),
        )
        .withColumn("_error_ts", F.when(F.col("_error") & (F.col("_ts") > 0), F.col("_ts")))
        .withColumn("_error_header", F.when(F.col("_error"), F.col("_header")))
    )


def mark_context(
    lines: DataFrame, is_error, spans: tuple[int, ...] | None = None, seed: DataFrame | None = None
) -> DataFrame:
    """Add ``detected``: error lines, and lines that belong to the last error.

    A line without a stamp continues the last error that had a header, however
    long ago. A stamped line belongs when its header is related and it is at most
    five seconds later (or earlier, kernel rings may be out of order).

    ``seed`` is the state left by earlier lines (see ``context_state``).
    """
    columns = lines.columns
    staged = _staged(lines, is_error)
    if seed is not None:
        before = seed.select(
            "source", F.lit(-1).cast("long").alias("line_no"), F.col("last_ts").alias("_error_ts"),
            F.col("last_header").alias("_error_header"), F.lit(True).alias("_seed"),
        )
        staged = staged.withColumn("_seed", F.lit(False)).unionByName(before, allowMissingColumns=True)
    carried = running(
        staged, ["source"], "line_no",
        {"_last_ts": (LAST, "_error_ts"), "_last_header": (LAST, "_error_header")}, spans,
    )
    if seed is not None:
        carried = carried.filter(~F.col("_seed"))
    continued = F.col("_stamp").isNull()
    near = F.col("_ts") - F.coalesce("_last_ts", F.lit(0.0)) <= RELATED_SECONDS
    related = (
        F.col("_header").isNotNull() & (F.col("_ts") > 0) & near
        & headers_related("_last_header", "_header")
    )
    detected = F.col("_error") | (F.col("_last_header").isNotNull() & (continued | related))
    return carried.withColumn("detected", F.coalesce(detected, F.lit(False))).select(*columns, "detected")


def context_state(lines: DataFrame, is_error, seed: DataFrame | None = None) -> DataFrame:
    """``(source, last_ts, last_header)`` after these lines, for the lines to come."""
    rows = _staged(lines, is_error).select("source", "line_no", "_error_ts", "_error_header")
    if seed is not None:
        rows = rows.unionByName(seed.select(
            "source", F.lit(-1).cast("long").alias("line_no"), F.col("last_ts").alias("_error_ts"),
            F.col("last_header").alias("_error_header"),
        ))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return rows.groupBy("source").agg(
        latest("_error_ts").alias("last_ts"), latest("_error_header").alias("last_header")
    )
