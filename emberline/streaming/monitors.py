"""All monitors over one stream of lines.

What a line alone tells is computed by the columns of the batch operators. Only issue lines
(and the lines of kernel logs, whose context depends on order) reach the state, which is kept
by Spark per monitor and source: the open batch, the last kernel error, the limiter window, the
last sign of life and two timers. The timers fire by themselves, so an idle batch and a silent
source are reported although no line arrives. State of a source that has gone expires.

A source is read in order, so its rows of one micro-batch are worked on by one task. Bound a
micro-batch by the options of the source that feeds it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.functions.basics import trim_space
from emberline.functions.text import byte_length, parse_duration
from emberline.operators.batches import MAX_BYTES, MAX_LINES, WINDOW_SECONDS
from emberline.operators.context import RELATED_SECONDS, kernel_parts
from emberline.operators.detect import Detector, dmesg_detector, monitor_rules
from emberline.operators.limits import limiter_window
from emberline.operators.metrics import observed, progress_counts
from emberline.plans.flow import assigned, events_of, numbered_monitors
from emberline.functions.timestamps import with_timestamps
from emberline.session import configure
from emberline.streaming import states

IDLE_SECONDS = 5.0
#: Spark's setting for the store that such state needs, and its value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ("monitor", "source", "issue", "line_no", "line", "ts", "ts_str", "n_bytes", "kernel", "error", "excluded", "stamped", "at", "header")


class MonitorStream:
    """The flow of ``issues_to_events`` over a stream ``(monitor, source, line_no, line)``.

    ``line_no`` must rise inside a source over the whole stream (the tail source gives byte
    positions). ``sources`` lists ``(monitor name, source)`` that are expected to speak: their
    silence counts from the start of the stream. Without it those of monitors that read one
    file are taken. ``idle`` ends a batch that got no line for so long (None: never).
    ``line_clock`` limits by the time in the lines instead of the wall clock. State that was not
    touched for ``ttl`` seconds goes (None: never). ``counted`` counts lines and events on the way (see ``counts``).
    """

    def __init__(
        self, spark: SparkSession, tenant: dict, monitors: list[dict], as_of: float | None = None,
        sources: list[tuple[str, str | None]] | None = None, window: float = WINDOW_SECONDS, max_lines: int = MAX_LINES,
        max_bytes: int = MAX_BYTES, idle: float | None = IDLE_SECONDS, line_clock: bool = False, ttl: float | None = None,
        counted: bool = False,
    ):
        self.spark, self.tenant, self.as_of = configure(spark), tenant, as_of
        self.monitors = numbered_monitors(monitors)
        self.sources, self.counted = sources, counted
        self.settings = {
            "window": window, "max_lines": max_lines, "max_bytes": max_bytes, "line_clock": line_clock,
            "idle_ms": None if idle is None else int(idle * 1000), "related": RELATED_SECONDS,
            "ttl_ms": None if ttl is None else int(ttl * 1000),
        }
        self.rules = self._rules()

    def _rules(self) -> dict[str, dict]:
        """Limits and silence of each monitor; durations are read as everywhere, by Spark."""
        rows = [(m["id"], int(m.get("rate_limit_burst") or 0), m.get("rate_limit_window") or "", m.get("max_inactivity") or "") for m in self.monitors]
        table = self.spark.createDataFrame(rows, "id string, burst int, window string, silence string").select(
            "id", "burst", limiter_window(F.col("window")).alias("window"), F.coalesce(parse_duration("silence"), F.lit(0.0)).alias("silence"))
        return {r.id: {"burst": r.burst, "window_us": round(r.window * 1e6), "silence_ms": int(r.silence * 1000)} for r in table.collect()}

    @property
    def watches(self) -> bool:
        return any(r["silence_ms"] > 0 for r in self.rules.values())

    def _expected(self) -> DataFrame:
        """``monitor, source`` of the sources whose silence counts from the start."""
        pairs = self.sources
        if pairs is None:
            pairs = [(m["name"], m["name"]) for m in self.monitors if m.get("path") and not set(m["path"]) & set("*?[]")]
        ids: dict[str, list[str]] = {}
        for m in self.monitors:
            ids.setdefault(m["name"], []).append(m["id"])
        rows = sorted({(i, source) for name, source in pairs for i in ids.get(name, []) if self.rules[i]["silence_ms"] > 0}, key=str)
        return self.spark.createDataFrame(rows, "monitor string, source string")

    # --- the stages ---

    def staged(self, lines: DataFrame) -> DataFrame:
        """Narrow rows for the state: issue lines, all lines of kernel logs, and signs of life."""
        choose, kernel_names = monitor_rules(self.monitors)
        lines = assigned(lines, self.monitors).select("monitor", "source", "line_no", "line")
        kernel = F.col("monitor").isin(kernel_names) if kernel_names else F.lit(False)
        match, stamp, exclude = choose("match", False), choose("stamp", None), choose("exclude", None)
        test = lambda build: F.coalesce(build(F.col("line")), F.lit(False)) if build else F.lit(False)
        rows = lines.withColumn("kernel", kernel).withColumn("excluded", test(exclude)).withColumn("_match", test(match))
        rows = rows.withColumn("issue", F.col("kernel") | (F.col("_match") & ~F.col("excluded")))
        if self.counted:
            plain = [m["id"] for m in self.monitors if m["id"] not in kernel_names]
            rows = observed(rows, "lines", plain, {
                "processed_lines": F.lit(True), "matched": F.col("_match"), "excluded": F.col("_match") & F.col("excluded"),
                "issues_detected": F.col("issue")})
        if not self.watches:
            rows = rows.filter("issue")
        rows = rows.withColumn("line", F.when(F.col("issue"), F.col("line")))
        rows = with_timestamps(rows, Detector("monitors", lambda line: F.lit(True), stamp), self.as_of)
        nothing = {"error": F.lit(False), "stamped": F.lit(False), "at": F.lit(0.0), "header": F.lit(None).cast("string")}
        if kernel_names:
            parts, detector = kernel_parts("line", dmesg_detector().match), dmesg_detector()
            parts["header"] = trim_space(parts["header"])
            nothing = {k: F.when(F.col("kernel"), v).otherwise(nothing[k]) for k, v in parts.items()}
            rows = rows.withColumns(nothing).withColumn("line", F.when(F.col("kernel"), detector.message(F.col("line"))).otherwise(F.col("line")))
        else:
            rows = rows.withColumns(nothing)
        rows = rows.withColumns({"line": F.coalesce("line", F.lit("")), "n_bytes": F.coalesce(byte_length("line"), F.lit(0)).cast("long")}).select(*COLUMNS)
        return rows.mapInArrow(states.activity_once, rows.schema) if self.watches else rows

    def results(self, lines: DataFrame) -> DataFrame:
        """Finished batches and alerts (``alert`` not null) of a streaming table of lines."""
        self.spark.conf.set(*STORE)
        keys = ["monitor", "source"]
        expected = self._expected() if self.watches else None
        return self.staged(lines).groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=states.SourceProcessor(self.rules, self.settings), outputStructType=states.RESULT,
            outputMode="append", timeMode="ProcessingTime", initialState=expected.groupBy(*keys) if expected is not None else None)

    def events(self, results: DataFrame) -> DataFrame:
        """Events of batches and of alerts, with the tenant of their monitor."""
        return events_of(results, self.tenant, self.monitors)

    def counts(self, progress: list) -> dict[str, dict[str, int]]:
        """Lines and events counted in these micro-batches, by monitor name: pass a query's ``recentProgress``, or
        the progress that a listener gets. Lines of kernel logs are not counted, as what matches depends on order."""
        return progress_counts(progress, {m["id"]: m["name"] for m in self.monitors})

    def start(
        self, lines: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False,
        every: str = "1 second",
    ) -> StreamingQuery:
        """Run; events of epoch N go to the folder ``sink/epoch=N``, or to ``sink(events, N)``. A repeated
        epoch starts from the same state and overwrites its folder."""
        def body(batch: DataFrame, epoch: int) -> None:
            if callable(sink):
                sink(batch, epoch)
            else:
                batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

        # Timers need batches without data; a bounded run ends when there is none.
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not available_now).lower())
        results = self.results(lines)
        if self.counted:
            done = F.col("alert").isNull()
            results = observed(results, "events", [m["id"] for m in self.monitors], {
                "events": done, "events_sent": done & F.col("passed"), "events_dropped": done & ~F.col("passed")})
        writer = self.events(results).writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
        return writer.start()

    def drain(self, checkpoint: str) -> DataFrame:
        """Events of the batches that a stopped stream has left open, read from its state, which stays as it is."""
        operators = self.spark.read.format("state-metadata").load(checkpoint).filter(F.col("operatorName").startswith("transformWithState"))
        operator = operators.select("operatorId").first()[0]

        def state(name: str) -> DataFrame:
            reader = self.spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", name)
            return reader.option("flattenCollectionTypes", "false").load() if name == "lines" else reader.load()

        key = [F.col("key.monitor").alias("monitor"), F.col("key.source").alias("source")]
        batch = state("batch").select(*key, "value.*")
        lines = state("lines").select(*key, F.col("list_value").alias("texts"))
        limits = state("limiter").select(*key, F.struct("value.*").alias("limit"))
        same = lambda other, name: (F.col("b.monitor") == F.col(f"{name}.monitor")) & F.col("b.source").eqNullSafe(F.col(f"{name}.source"))
        joined = batch.alias("b").join(lines.alias("l"), same(lines, "l")).join(limits.alias("m"), same(limits, "m"), "left").select(
            "b.*", F.transform("l.texts", lambda x: x["line"]).alias("texts"), "m.limit")
        rules = self.spark.createDataFrame([(k, r["burst"], r["window_us"]) for k, r in self.rules.items()], "monitor string, burst int, window_us long")
        clock = F.round(F.col("start_ts") * F.lit(1e6)).cast("long") if self.settings["line_clock"] else F.lit(int(time.time() * 1e6))
        opened = F.col("limit").isNull() | (F.greatest("limit.clock", clock) - F.col("limit.opened") > F.col("window_us"))
        passed: Column = (F.col("burst") <= 0) | opened | (F.col("limit.used") < F.col("burst"))
        rows = joined.join(rules, "monitor").withColumns({"message": F.array_join("texts", "\n"), "passed": passed}).select(
            "monitor", "source", "batch_id", "first_line_no", "last_line_no", "start_ts", "ts_str", F.col("texts")[0].alias("first_line"),
            F.size("texts").cast("long").alias("n_lines"), F.octet_length("message").cast("long").alias("n_bytes"), "message", "passed",
            F.lit(None).cast("string").alias("alert"), F.lit(None).cast("double").alias("at"))
        return self.events(rows)


def unique_lines(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Lines that a shipper may hand over more than once, each once: known by monitor, source and number for
    ``delay`` after it arrived. What is older than that leaves the state."""
    keys = ["monitor", "source", "line_no"]
    timed = lines.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_arrived")
