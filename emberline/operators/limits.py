"""Rate limiting of events per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import parse_duration
from emberline.plans import chains
from emberline.plans.ordered import MAX, SUM, running, spans_for
from emberline.plans.joins import join_keys
from emberline.plans.storage import cut, largest_group, shared_folder

DEFAULT_WINDOW_SECONDS = 1.0


def limiter_window(text) -> Column:
    """Seconds of a configured window: one second when missing, zero when malformed."""
    t = text if isinstance(text, Column) else F.lit(text)
    return F.when(t.isNull() | (t == ""), DEFAULT_WINDOW_SECONDS).otherwise(
        F.coalesce(parse_duration(t), F.lit(0.0))
    )


def _micros(seconds: Column) -> Column:
    return F.round(seconds.cast("double") * F.lit(1e6)).cast("long")


def window_ranks(
    events: DataFrame,
    window=DEFAULT_WINDOW_SECONDS,
    clock: str = "start_ts",
    order: str = "batch_id",
    seed: DataFrame | None = None,
    largest: int | None = None,
    spans: tuple[int, ...] | None = None,
    block_rows: int = chains.BLOCK_ROWS,
    fan: int = chains.BLOCKS_PER_SUPER,
) -> DataFrame:
    """``(source, order, opened, rank)``: position of the event (by row number) that
    opened the window of each event, and how many events of the window come before.

    A window opens at the first event and again at the first event more than
    ``window`` later. The clock is the running maximum of the column, since a wall
    clock never goes back; this opens the same windows as the column itself.

    ``seed`` (``source, opened_us, used``) is the window left open by earlier
    events; it takes part as a row of its own. ``largest`` is the number of events
    of the biggest source, if known.
    """
    spans = spans_for(largest) if spans is None else spans
    largest = None if largest is None else largest + 1
    width = window if isinstance(window, Column) else F.lit(float(window))
    rows = events.select(
        "source", F.col(order), _micros(F.col(clock)).alias("_clock"), _micros(width).alias("window"),
        F.lit(1).cast("long").alias("_one"),
    )
    if seed is not None:
        known = rows.groupBy("source").agg(F.max("window").alias("window"))
        rows = rows.unionByName(
            join_keys(seed, known, ["source"]).select(
                "source", F.lit(-1).cast("long").alias(order), F.col("opened_us").alias("_clock"), "window",
                F.lit(1).cast("long").alias("_one"),
            )
        )
    rows = running(rows, ["source"], order, {"_seen": (MAX, "_clock"), "ordinal": (SUM, "_one")}, spans)
    rows = rows.select(
        "source", order, "window", F.greatest("_seen", "_clock").alias("clock"),
        F.coalesce("ordinal", F.lit(0)).cast("long").alias("ordinal"),
    )
    marked = chains.anchored(rows, ["source"], order, chains.clock_block(), 0, block_rows, fan, largest)
    rank = F.col("ordinal") - F.col("anchor")
    if seed is None:
        return marked.select("source", order, F.col("anchor").alias("opened"), rank.alias("rank"))
    used = seed.select("source", "used")
    in_seed = (F.col("anchor") == 0) & F.col("used").isNotNull()
    return (
        join_keys(marked, used, ["source"], "left")
        .filter(F.col(order) >= 0)
        .select(
            "source", order, F.col("anchor").alias("opened"),
            F.when(in_seed, rank - 1 + F.col("used")).otherwise(rank).alias("rank"),
        )
    )


def rate_limit(
    events: DataFrame, burst, window=DEFAULT_WINDOW_SECONDS, clock: str = "start_ts", order: str = "batch_id",
    stored: bool = False, lazy: bool = False, **plan,
) -> DataFrame:
    """Add ``passed``: whether the event is among the first ``burst`` of its window.

    ``burst`` and ``window`` (seconds) are numbers or Columns of ``events`` that
    are constant per source; a burst of zero or less lets everything pass.

    The events are read by several passes, so they are written once to the shared
    folder (unless ``stored`` or ``lazy``), where the biggest source is counted.
    """
    if not lazy and (stored or shared_folder(events.sparkSession)):
        events = events if stored else cut(events)
        plan.setdefault("largest", largest_group(events, ["source"]))
    limit = burst if isinstance(burst, Column) else F.lit(int(burst))
    ranks = window_ranks(events, window, clock, order, **plan)
    return (
        join_keys(events, ranks, ["source", order])
        .withColumn("passed", (limit <= 0) | (F.col("rank") < limit))
        .drop("rank", "opened")
    )


def limiter_state(events: DataFrame, burst: int, window=DEFAULT_WINDOW_SECONDS, clock: str = "start_ts",
                  order: str = "batch_id", seed: DataFrame | None = None, **plan) -> DataFrame:
    """``(source, opened_us, used)``: the window left open after these events."""
    ranks = window_ranks(events, window, clock, order, seed=seed, **plan)
    clocks = events.select("source", F.col(order), _micros(F.col(clock)).alias("_clock"))
    rows = join_keys(clocks, ranks, ["source", order])
    windows = rows.groupBy("source", "opened").agg(
        F.min_by("_clock", order).alias("_first"), (F.max("rank") + 1).alias("_used"), F.min("rank").alias("_low")
    )
    latest = windows.groupBy("source").agg(F.max_by(F.struct("_first", "_used", "_low"), "opened").alias("w"))
    if seed is None:
        return latest.select(
            "source", F.col("w._first").alias("opened_us"), F.least("w._used", F.lit(int(burst))).alias("used")
        )
    sources = latest.select("source").unionByName(seed.select("source")).distinct()
    joined = join_keys(join_keys(sources, latest, ["source"], "left"), seed, ["source"], "left")
    continued = F.col("w._low") > 0
    return joined.select(
        "source",
        F.when(F.col("w").isNull() | continued, F.col("opened_us")).otherwise(F.col("w._first")).alias("opened_us"),
        F.when(F.col("w").isNull(), F.col("used"))
        .otherwise(F.least(F.col("w._used"), F.lit(int(burst)))).cast("long").alias("used"),
    )
