"""Anchored grouping of ordered rows, spread over blocks of a group.

Plan: number the rows of each group, cut them into blocks of equal length, turn
each block into its step function, compose those over super-blocks, walk the few
super-blocks of a group to get the state at each boundary, walk back down, and
mark the rows of every block. Only narrow rows (order, timestamp, length) enter
Python, one bounded block at a time, so a group may hold any share of the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.basics import int_div
from emberline.plans import kernels

BLOCK_ROWS = 1 << 17
BLOCKS_PER_SUPER = 64


def _fields(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def anchored(
    rows: DataFrame,
    keys: list[str],
    order: str,
    block: Callable,
    overlap: int = 0,
    block_rows: int = BLOCK_ROWS,
    fan: int = BLOCKS_PER_SUPER,
    largest: int | None = None,
) -> DataFrame:
    """``rows`` (with ``ordinal``) to ``(keys, order, ordinal, anchor)``.

    ``block`` is one of the block types of the kernels; ``overlap`` is how many
    rows after a block it needs to see. ``largest`` is the size of the biggest
    group if it was measured: levels that would have a single member are left out.
    """
    if overlap > block_rows:
        raise ValueError("a block must be at least as long as its overlap")
    result_type = f"{_fields(rows, [*keys, order])}, ordinal bigint, anchor bigint"
    if largest is not None and largest <= block_rows:
        return rows.withColumn("own", F.lit(1)).groupBy(*keys).applyInPandas(
            kernels.anchors_of_whole(block, keys, order), result_type
        )
    home = int_div(F.col("ordinal"), block_rows)
    placed = rows.withColumn("block", home).withColumn("own", F.lit(1))
    if overlap:
        shared = (F.col("ordinal") % block_rows < overlap) & (home > 0)
        placed = rows.withColumn(
            "block", F.explode(F.when(shared, F.array(home, home - 1)).otherwise(F.array(home)))
        ).withColumn("own", (F.col("block") == home).cast("int"))

    key_types = _fields(rows, keys)
    steps_type = "at array<double>, `to` array<double>, anchor array<bigint>, reach double"
    state_type = "pos double, `open` bigint"
    by_block = placed.groupBy(*keys, "block")
    steps = by_block.applyInPandas(
        kernels.steps_of_block(block, keys), f"{key_types}, block bigint, {steps_type}"
    ).withColumn("super", int_div(F.col("block"), fan))
    if largest is not None and largest <= block_rows * fan:
        block_states = steps.groupBy(*keys).applyInPandas(
            kernels.walk_from_start(keys, "block"), f"{key_types}, block bigint, {state_type}"
        )
    else:
        supers = steps.groupBy(*keys, "super").applyInPandas(
            kernels.steps_of_group(keys, "block", "super"), f"{key_types}, super bigint, {steps_type}"
        )
        super_states = supers.groupBy(*keys).applyInPandas(
            kernels.walk_from_start(keys, "super"), f"{key_types}, super bigint, {state_type}"
        )
        block_states = (
            steps.groupBy(*keys, "super")
            .cogroup(super_states.groupBy(*keys, "super"))
            .applyInPandas(kernels.walk_from_state(keys, "block"), f"{key_types}, block bigint, {state_type}")
        )
    return by_block.cogroup(block_states.groupBy(*keys, "block")).applyInPandas(
        kernels.anchors_of_block(block, keys, order), result_type
    )


def capped_block(window: float, max_lines: int, max_bytes: int) -> Callable:
    return partial(kernels.capped_block, window=window, max_lines=max_lines, max_bytes=max_bytes)


def clock_block() -> Callable:
    return kernels.clock_block


__all__ = ["BLOCK_ROWS", "BLOCKS_PER_SUPER", "anchored", "capped_block", "clock_block"]
