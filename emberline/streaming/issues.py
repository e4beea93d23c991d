"""The issue flow over a stream of lines.

Each micro-batch is worked on by the batch operators, so a busy source is spread
over the cluster here too. What a source leaves open (the last batch, the last
kernel error, the limiter window) is a small table per micro-batch, written under
``state`` as ``epoch=N`` and read by the next one. A micro-batch that is run again
after a failure reads the same state and overwrites its own output, so events come
out once.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.batches import MAX_BYTES, MAX_LINES, WINDOW_SECONDS, group_batches
from emberline.operators.context import context_state
from emberline.operators.detect import Detector, matched_lines
from emberline.operators.events import build_events
from emberline.operators.limits import limiter_state, rate_limit
from emberline.plans.joins import join_keys
from emberline.plans.storage import cut, largest_group

IDLE_SECONDS = 5.0

OPEN_LINES = (
    "source string, line_no long, line string, ts double, ts_str string, n_bytes long, origin long, touched double, begun long"
)
CONTEXT = "source string, last_ts double, last_header string"
LIMITER = "source string, opened_us long, used long"


class IssueStream:
    """State handling for one stream; ``process`` is the body of a ``foreachBatch``."""

    def __init__(
        self,
        spark: SparkSession,
        detector: Detector,
        state: str,
        exclude: str | None = None,
        window: float = WINDOW_SECONDS,
        max_lines: int = MAX_LINES,
        max_bytes: int = MAX_BYTES,
        burst: int = 0,
        limit_window: float = 1.0,
        idle: float | None = IDLE_SECONDS,
        as_of: float | None = None,
    ):
        self.spark, self.detector, self.state = spark, detector, state.rstrip("/")
        self.exclude, self.as_of, self.idle = exclude, as_of, idle
        self.rule = {"window": window, "max_lines": max_lines, "max_bytes": max_bytes}
        self.burst, self.limit_window = burst, limit_window

    # --- state tables ---

    def _path(self, name: str, epoch: int) -> str:
        return f"{self.state}/{name}/epoch={epoch}"

    def _load(self, name: str, schema: str, epoch: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(name, epoch))

    def _save(self, df: DataFrame, name: str, schema: str, epoch: int) -> None:
        fields = [f.split()[0] for f in schema.split(", ")]
        df.select(*fields).write.mode("overwrite").parquet(self._path(name, epoch))

    # --- one micro-batch ---

    def _matched(self, lines: DataFrame, epoch: int) -> DataFrame:
        if not self.detector.related:
            return matched_lines(lines, self.detector, self.exclude, self.as_of)
        seed = self._load("context", CONTEXT, epoch - 1) if epoch > 0 else None
        self._save(context_state(lines, self.detector.match, seed), "context", CONTEXT, epoch)
        return matched_lines(lines, self.detector, self.exclude, self.as_of, seed=seed)

    def batches(self, lines: DataFrame, epoch: int, now: float | None = None, close: bool = False) -> DataFrame:
        """Finished batches after the lines of this epoch; the open ones become state.

        ``lines`` has ``(source, line_no, line)`` with ``line_no`` rising within the
        epoch. ``close`` finishes everything.
        """
        now = time.time() if now is None else now
        fields = [f.split()[0] for f in OPEN_LINES.split(", ")]
        rows = self._matched(lines, epoch).withColumns(
            {"origin": F.col("line_no"), "touched": F.lit(now), "begun": F.lit(epoch).cast("long")})
        rows, flushed = rows.select(*fields), None
        if epoch > 0:
            before = self._load("open", OPEN_LINES, epoch - 1)
            if self.idle is not None:
                # An idle batch was flushed before the new lines came, so they cannot join it.
                idle = F.lit(now) - F.col("touched") >= self.idle
                flushed = group_batches(before.filter(idle), keep=("origin", "begun"), stored=True, **self.rule)
                before = before.filter(~idle)
            rows = rows.unionByName(before)
        # Read back in the main session: a micro-batch's own session has adaptive execution off.
        rows = cut(rows, self.spark)
        groups = group_batches(rows, keep=("origin", "begun"), stored=True, **self.rule)
        ends = rows.groupBy("source").agg(F.max("line_no").alias("_end"), F.max("touched").alias("touched"))
        flagged = cut(
            join_keys(groups, ends.drop("touched"), ["source"])
            .withColumn("_open", (F.col("last_line_no") == F.col("_end")) & F.lit(not close))
        )
        kept = flagged.filter("_open").select("source", "first_line_no")
        # Open lines go before all lines to come: their numbers end at -1.
        placed = (
            join_keys(join_keys(rows.drop("touched"), kept, ["source"]), ends, ["source"])
            .filter(F.col("line_no") >= F.col("first_line_no")).withColumn("line_no", F.col("line_no") - F.col("_end") - 1)
        )
        self._save(placed, "open", OPEN_LINES, epoch)
        done = flagged.filter("NOT _open").drop("_end", "_open")
        done = done.withColumn("batch_id", F.col("batch_id") + 1)
        if flushed is not None:
            done = done.unionByName(flushed.withColumn("batch_id", F.lit(0).cast("long")).select(*done.columns))
        return done.withColumn("first_line_no", F.col("origin")).drop("origin").filter(
            (F.col("message") != "") | F.lit(close)
        )

    def events(self, lines: DataFrame, epoch: int, now: float | None = None, close: bool = False) -> DataFrame:
        """Finished batches as events; with a burst they carry ``passed``."""
        done = self.batches(lines, epoch, now, close)
        if self.burst > 0:
            done = cut(done)
            seed = self._load("limiter", LIMITER, epoch - 1) if epoch > 0 else None
            known = {"seed": seed, "largest": largest_group(done, ["source"])}
            left = limiter_state(done, self.burst, self.limit_window, **known)
            limited = rate_limit(done, self.burst, self.limit_window, lazy=True, **known)
            self._save(left, "limiter", LIMITER, epoch)
            done = limited
        return build_events(done, self.detector)

    # --- running it ---

    def start(
        self, stream: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str,
        number: Callable[[DataFrame], DataFrame] | None = None,
        available_now: bool = False, every: str = "5 seconds", heartbeat: bool = False,
    ) -> StreamingQuery:
        """Run over a streaming DataFrame; events of epoch N go to the folder
        ``sink/epoch=N``, or to ``sink(events, N)``.

        ``number`` gives ``line_no`` to a micro-batch that has none. ``heartbeat``
        adds a clock row a second, so that idle batches are flushed while no line
        arrives at all.
        """
        if heartbeat:
            tick = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
            stream = stream.withColumn("_tick", F.lit(False)).unionByName(
                tick.select(F.lit(True).alias("_tick")), allowMissingColumns=True
            )

        def body(batch: DataFrame, epoch: int) -> None:
            lines = batch.filter(~F.col("_tick")).drop("_tick") if heartbeat else batch
            numbered = number(lines) if number else lines
            self._emit(self.events(numbered, epoch), epoch, sink)

        writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
        return writer.start()

    @staticmethod
    def _emit(events: DataFrame, epoch: int, sink) -> None:
        if callable(sink):
            sink(events, epoch)
        else:
            events.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    def drain(self, epoch: int, sink: str | Callable[[DataFrame, int], None] | None = None) -> DataFrame:
        """Finish what is open after the stream has ended (``epoch`` is its last one)."""
        none = self.spark.createDataFrame([], "source string, line_no long, line string")
        rest = self.events(none, epoch + 1, close=True)
        if sink:
            self._emit(rest, epoch + 1, sink)
        return rest
