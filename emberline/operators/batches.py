"""Grouping issue lines into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.basics import int_div
from emberline.functions.timestamps import extract_timestamp_key
from emberline.plans import chains
from emberline.plans.ordered import spans_for, with_ordinals
from emberline.plans.joins import join_keys
from emberline.plans.storage import cut, largest_group, shared_folder

WINDOW_SECONDS = 5.0
MAX_LINES = 1000
MAX_BYTES = 256 * 1024


def ordered_rows(*columns: str, order: str = "line_no") -> Column:
    """Aggregate: the rows of a (bounded) group in order, as an array of structs."""
    return F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *columns)))


def ordered_concat(rows: Column, field: str = "line", separator: str = "\n") -> Column:
    """Texts of ``ordered_rows`` joined in order."""
    return F.array_join(F.transform(rows, lambda r: r[field]), separator)


def _collect(grouped, keep: tuple[str, ...] = ()) -> DataFrame:
    """One collected array per batch; the caps bound its size. What the first line
    decides is read from the array rather than aggregated beside it."""
    first, rows = F.col("_rows")[0], F.col("_rows")
    return (
        grouped.agg(ordered_rows("line", "ts", "ts_str", *keep).alias("_rows"))
        .withColumn("lines", F.transform(rows, lambda r: r["line"]))
        .withColumn("message", F.array_join("lines", "\n"))
        .select(
            "source", "batch_id", *[first[c].alias(c) for c in keep],
            first["at"].alias("first_line_no"), F.element_at(rows, -1)["at"].alias("last_line_no"),
            first["ts"].alias("start_ts"), first["ts_str"].alias("ts_str"), first["line"].alias("first_line"),
            F.size(rows).cast("long").alias("n_lines"), F.octet_length("message").cast("long").alias("n_bytes"),
            "lines", "message",
        )
    )


def _stored(df: DataFrame, keys: list[str], stored: bool, lazy: bool) -> tuple[DataFrame, int | None]:
    """The table to make several passes over, and its biggest group if it is cheap to tell."""
    if lazy or (not stored and shared_folder(df.sparkSession) is None):
        return df, None
    table = df if stored else cut(df)
    return table, largest_group(table, keys)


def assign_batches(
    matched: DataFrame,
    window: float = WINDOW_SECONDS,
    max_lines: int = MAX_LINES,
    max_bytes: int = MAX_BYTES,
    largest: int | None = None,
    spans: tuple[int, ...] | None = None,
    block_rows: int = chains.BLOCK_ROWS,
    fan: int = chains.BLOCKS_PER_SUPER,
) -> DataFrame:
    """``(source, line_no, batch_id)``; ``batch_id`` is the position of the batch's
    first line among the issue lines of its source.

    A batch starts at its first line and takes the following ones until one is
    stamped more than ``window`` seconds after that first line, or a cap is hit.
    ``largest`` is the number of issue lines of the biggest source, if known.
    """
    narrow = matched.select("source", "line_no", "ts", "n_bytes")
    numbered = with_ordinals(
        narrow, ["source"], "line_no", spans=spans_for(largest) if spans is None else spans
    )
    marked = chains.anchored(
        numbered, ["source"], "line_no", chains.capped_block(window, max_lines, max_bytes),
        overlap=max_lines, block_rows=max(block_rows, max_lines), fan=fan, largest=largest,
    )
    return marked.select("source", "line_no", F.col("anchor").alias("batch_id"))


def group_batches(
    matched: DataFrame, keep: tuple[str, ...] = (), stored: bool = False, lazy: bool = False, **rule
) -> DataFrame:
    """Batches of issue lines (see ``assign_batches`` for the rule and its options).

    The issue lines are read by several passes, so they are written once to the
    shared folder and the biggest source is counted there, which shortens the plan
    when all sources are small. ``stored`` tells that they are a stored table
    already; ``lazy`` plans without either step. ``keep`` names columns whose value
    on the first line is carried over.
    """
    issues = matched.select("source", "line_no", "line", "ts", "ts_str", "n_bytes", *keep)
    issues, largest = _stored(issues, ["source"], stored, lazy)
    joined = join_keys(issues, assign_batches(issues, largest=largest, **rule), ["source", "line_no"])
    return _collect(joined.groupBy("source", "batch_id"), keep)


def sendable(batches: DataFrame, matched: DataFrame) -> DataFrame:
    """Drop empty messages, except a source's last batch: only the closing flush
    sends an empty text. ``matched`` are the lines the batches were made of."""
    ends = matched.groupBy("source").agg(F.max("line_no").alias("_end"))
    return (
        join_keys(batches, ends, ["source"])
        .filter((F.col("message") != "") | (F.col("last_line_no") == F.col("_end")))
        .drop("_end")
    )


def batches_by_count(
    matched: DataFrame, max_lines: int = MAX_LINES, stored: bool = False, lazy: bool = False
) -> DataFrame:
    """Batches of a fixed number of lines, whatever their time."""
    issues = matched.select("source", "line_no", "line", "ts", "ts_str", "n_bytes")
    issues, largest = _stored(issues, ["source"], stored, lazy)
    numbered = with_ordinals(issues, ["source"], "line_no", spans=spans_for(largest))
    return _collect(
        numbered.withColumn("batch_id", int_div(F.col("ordinal"), max_lines)).groupBy("source", "batch_id")
    )


def group_by_timestamp(
    matched: DataFrame, flush_lines: int = MAX_LINES, key: Column | None = None, stored: bool = False,
    lazy: bool = False,
) -> DataFrame:
    """Lines of one source with the same timestamp text, wherever they stand.

    A key may hold any number of lines (all those without a timestamp share one),
    so a group comes out in ``part``s of at most ``flush_lines`` lines, in order.
    """
    keyed = matched.select(
        "source", "line_no", "line", (extract_timestamp_key("line") if key is None else key).alias("ts_key")
    )
    keyed, largest = _stored(keyed, ["source", "ts_key"], stored, lazy)
    numbered = with_ordinals(keyed, ["source", "ts_key"], "line_no", spans=spans_for(largest))
    return (
        numbered.withColumn("part", int_div(F.col("ordinal"), flush_lines))
        .groupBy("source", "ts_key", "part")
        .agg(ordered_rows("line").alias("_rows"))
        .select(
            "source", "ts_key", "part", F.size("_rows").cast("long").alias("line_count"),
            F.col("_rows")[0]["at"].alias("first_line_no"), F.transform("_rows", lambda r: r["line"]).alias("lines"),
        )
    )
