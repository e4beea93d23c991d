"""Ordered state over huge groups: running values and row ordinals.

A window over ``partitionBy(source)`` puts a whole source into one task. Here a
source is cut into spans of its order column. Each span is summarised by a
partial aggregation, the short summary table is scanned in the same way (so the
recursion, not one task, absorbs a source that holds most of the rows), and the
result is joined back as the carry into each span; the remaining window sees one
span at a time. No side is broadcast by hint: Spark picks the join from sizes.

The summary is written to the shared folder once. It holds the row counts, so it
also tells when all sources are small enough for the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.basics import int_div
from emberline.plans.joins import join_keys
from emberline.plans.storage import cut, shared_folder

# Width of a span in units of the order column, from the finest level upwards.
SPANS = (1 << 16, 1 << 16)

# A group of at most this many rows may be one window partition.
PLAIN_ROWS = 1 << 17

LAST, MAX, SUM = "last", "max", "sum"


def spans_for(largest: int | None, spans: tuple[int, ...] = SPANS) -> tuple[int, ...]:
    """No spans for groups measured to be small, the usual ones otherwise."""
    return () if largest is not None and largest <= PLAIN_ROWS else spans


def _summary(how: str, value: str, order: str) -> Column:
    if how == LAST:
        return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    return F.max(value) if how == MAX else F.sum(value)


def _before(how: str, value: str, window) -> Column:
    if how == LAST:
        return F.last(value, ignorenulls=True).over(window)
    return F.max(value).over(window) if how == MAX else F.sum(value).over(window)


def _merge(how: str, local: Column, carry: Column) -> Column:
    if how == LAST:
        return F.coalesce(local, carry)
    if how == MAX:
        return F.greatest(local, carry)
    return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))


def _plain(df: DataFrame, keys: list[str], order: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({out: _before(how, col, window) for out, (how, col) in wanted.items()})


def running(
    df: DataFrame, keys: list[str], order: str, wanted: dict[str, tuple[str, str]],
    spans: tuple[int, ...] | None = None,
) -> DataFrame:
    """Add, per output name, the aggregate of a column over all *earlier* rows of the group.

    ``wanted`` maps output name to ``(how, column)`` with how one of ``last``
    (last non-null), ``max`` or ``sum``. ``order`` must be a whole number, unique
    within the group.

    Without ``spans`` one pass over the table is made right away, to write the
    summary and measure the groups; with ``spans`` nothing is run, and ``()`` asks
    for the plain window.
    """
    if spans == ():
        return _plain(df, keys, order, wanted)
    measure = spans is None and shared_folder(df.sparkSession) is not None
    width, *above = spans or SPANS
    level = 1 + len(above)  # names differ by level, as a level's table joins the next one's
    span, size, outputs = f"_span{level}", f"_rows{level}", list(wanted.items())
    value = [f"_value{level}_{i}" for i in range(len(outputs))]
    carry = [f"_carry{level}_{i}" for i in range(len(outputs))]
    divided = df.withColumn(span, int_div(F.col(order), width))
    summary = divided.groupBy(*keys, span).agg(
        *[_summary(how, col, order).alias(v) for v, (_, (how, col)) in zip(value, outputs)],
        F.count(F.lit(1)).alias(size),
    )
    if measure:
        summary = cut(summary)
        groups = summary.groupBy(*keys).agg(F.sum(size).alias("rows"), F.count(F.lit(1)).alias("spans"))
        rows, spans_seen = groups.agg(F.max("rows"), F.max("spans")).first()
        if (rows or 0) <= PLAIN_ROWS:
            return _plain(df, keys, order, wanted)
        above = spans_for(spans_seen, tuple(above))
    carries = running(
        summary.drop(size), keys, span, {c: (how, v) for c, v, (_, (how, _)) in zip(carry, value, outputs)},
        tuple(above),
    ).drop(*value)
    window = Window.partitionBy(*keys, span).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return join_keys(divided, carries, [*keys, span]).withColumns(
        {out: _merge(how, _before(how, col, window), F.col(c)) for c, (out, (how, col)) in zip(carry, outputs)}
    ).drop(span, *carry)


def with_ordinals(
    df: DataFrame, keys: list[str], order: str, name: str = "ordinal", spans: tuple[int, ...] | None = None
) -> DataFrame:
    """Add the 0-based position of each row in its group."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    counted = running(one, keys, order, {name: (SUM, "_one")}, spans)
    return counted.withColumn(name, F.coalesce(name, F.lit(0)).cast("long")).drop("_one")
