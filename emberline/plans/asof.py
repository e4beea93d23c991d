"""As-of join: the latest right row at or before each left row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.ordered import MAX, running, spans_for
from emberline.plans.storage import cut, largest_group, shared_folder

BUCKET_SECONDS = 3600.0
SALTS = 16


def asof_times(
    left: DataFrame, right: DataFrame, key: str, time: str, name: str = "matched_time",
    bucket_seconds: float = BUCKET_SECONDS, salts: int = SALTS, spans: tuple[int, ...] | None = None,
) -> DataFrame:
    """Add to ``left`` the ``time`` (DOUBLE seconds) of the latest ``right`` row of the
    same key at or before it, NULL when there is none.

    Time is cut into buckets; a bucket also gets the last right row from before it,
    so each stands alone. Left rows of one bucket are spread over ``salts`` parts
    that each see all its (few) right rows, so neither a busy key nor a busy bucket
    lands in one task. Only times are copied, never payload.
    """
    place = lambda c: F.floor(F.col(c) / bucket_seconds).cast("long")
    plain = [c for c, t in left.dtypes if "<" not in t and t != "variant"]
    lhs = left.withColumn("_bucket", place(time)).withColumn(
        "_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    )
    times = right.select(key, F.col(time).alias("_time")).withColumn("_bucket", place("_time"))
    per_bucket = (
        times.groupBy(key, "_bucket").agg(F.max("_time").alias("_top"))
        .unionByName(
            lhs.select(key, "_bucket").distinct().withColumn("_top", F.lit(None).cast("double"))
        )
        .groupBy(key, "_bucket").agg(F.max("_top").alias("_top"))
    )
    if spans is None and shared_folder(left.sparkSession) is not None:
        per_bucket = cut(per_bucket)
        spans = spans_for(largest_group(per_bucket, [key]))
    before = running(per_bucket, [key], "_bucket", {"_carry": (MAX, "_top")}, spans)
    candidates = (
        times.select(key, "_bucket", F.col("_time").alias("_at"), "_time")
        .unionByName(
            before.filter(F.col("_carry").isNotNull()).select(
                key, "_bucket", F.lit(None).cast("double").alias("_at"), F.col("_carry").alias("_time")
            )
        )
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .withColumn("_is_left", F.lit(0))
    )
    rows = lhs.withColumn("_at", F.col(time)).withColumn("_is_left", F.lit(1)).unionByName(
        candidates, allowMissingColumns=True
    )
    window = (
        Window.partitionBy(key, "_bucket", "_salt")
        .orderBy(F.col("_at").asc_nulls_first(), "_is_left")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn(name, F.last("_time", ignorenulls=True).over(window))
        .filter("_is_left = 1")
        .select(*left.columns, name)
    )


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, payload: str, **plan) -> DataFrame:
    """Left rows with the ``payload`` column of the matched right row (one row per key and time)."""
    timed = asof_times(left, right, key, time, "_matched", **plan)
    side = right.select(key, F.col(time).alias("_matched"), payload)
    return timed.join(side, [key, "_matched"], "left").drop("_matched")
