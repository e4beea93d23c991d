"""Sending events, with one table of outcomes.

Each task sends its events and writes what became of them beside the table; the commit (of a
batch write or of a stream's epoch) moves these files in. An event without an outcome counts
as not sent. So a crash between sending and committing loses nothing: the event is sent again,
and its id tells the receiver that it is a repeat.

The folder of outcomes must be visible to the driver and the tasks under one path or address
that Arrow's file systems open. The module is shipped by value and imports nothing from the package.
"""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

Sender = Callable[[str], bool]
OUTCOME = "event_id string, payload string, delivered boolean, error string, at double"
ARROW = pa.schema([("event_id", pa.string()), ("payload", pa.string()), ("delivered", pa.bool_()), ("error", pa.string()), ("at", pa.float64())])
FORMAT = "emberline_delivery"
#: Outcomes that one file's row group holds, and the folder of files that are not committed.
ROWS, STAGING = 4096, "_staging"


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    """A task's file of outcomes and how many of them are good."""

    file: str
    delivered: int
    failed: int


class Delivery:
    """What the batch and the streaming writer share."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.send: Sender = cloudpickle.loads(base64.b64decode(options["sender"]))

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = opened(self.path)
        store.create_dir(f"{root}/{STAGING}")
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.parquet"
        counts, rows = [0, 0], []
        with store.open_output_stream(f"{root}/{STAGING}/{name}") as out, pq.ParquetWriter(out, ARROW) as writer:
            for row in iterator:
                delivered, error = False, None
                try:
                    delivered = bool(self.send(row["payload"]))
                except Exception as problem:  # noqa: BLE001 - whatever a sender raises means "not delivered"
                    error = f"{type(problem).__name__}: {problem}"
                counts[delivered] += 1
                rows.append((row["event_id"], row["payload"], delivered, error, time.time()))
                if len(rows) >= ROWS:
                    writer.write_batch(_batch(rows))
                    rows = []
            if rows:
                writer.write_batch(_batch(rows))
        return Written(name, counts[True], counts[False])

    def publish(self, messages: list) -> None:
        """Move the files in. Each holds facts about its own events, so one at a time will do."""
        store, root = opened(self.path)
        for message in messages:
            if message is not None and store.get_file_info(f"{root}/{STAGING}/{message.file}").type != pa.fs.FileType.NotFound:
                store.move(f"{root}/{STAGING}/{message.file}", f"{root}/{message.file}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class BatchDelivery(Delivery, DataSourceWriter):
    def commit(self, messages) -> None:
        self.publish(messages)

    def abort(self, messages) -> None:
        """What tasks that ended well have sent was sent."""
        self.publish(messages)


class StreamDelivery(Delivery, DataSourceStreamWriter):
    def commit(self, messages, batchId) -> None:
        self.publish(messages)

    def abort(self, messages, batchId) -> None:
        self.publish(messages)


class DeliverySink(DataSource):
    """Options: ``path`` of the outcomes, ``sender`` (pickled, base64)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "event_id string, payload string"

    def writer(self, schema, overwrite) -> BatchDelivery:
        return BatchDelivery(self.options)

    def streamWriter(self, schema, overwrite) -> StreamDelivery:
        return StreamDelivery(self.options)


def _writer(writer, spark: SparkSession, send: Sender, outcomes: str):
    spark.dataSource.register(DeliverySink)
    sender = base64.b64encode(cloudpickle.dumps(send)).decode()
    return writer.format(FORMAT).option("path", outcomes).option("sender", sender)


def read_outcomes(spark: SparkSession, outcomes: str) -> DataFrame:
    return spark.read.schema(OUTCOME).parquet(outcomes)


def _never_delivered(letters: DataFrame, outcomes: DataFrame) -> DataFrame:
    return letters.join(outcomes.filter("delivered").select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])


def deliver_events(payloads: DataFrame, send: Sender, outcomes: str) -> None:
    """Send the rows ``(event_id, payload)`` that were not delivered yet, each id once, and add their outcomes
    to the table. ``send`` takes a payload; false or an exception means not delivered."""
    spark = payloads.sparkSession
    store, root = opened(outcomes)
    store.create_dir(root)
    fresh = _never_delivered(payloads.select("event_id", "payload"), read_outcomes(spark, outcomes))
    _writer(fresh.write, spark, send, outcomes).mode("append").save()


def stream_events(payloads: DataFrame, send: Sender, outcomes: str, checkpoint: str, available_now: bool = False):
    """The same for a stream of ``(event_id, payload)``; a repeated epoch may send again."""
    store, root = opened(outcomes)
    store.create_dir(root)
    writer = _writer(payloads.select("event_id", "payload").writeStream, payloads.sparkSession, send, outcomes).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def outstanding(spark: SparkSession, outcomes: str) -> DataFrame:
    """``event_id, payload, attempts`` of the events that were tried and never delivered."""
    return read_outcomes(spark, outcomes).groupBy("event_id").agg(
        F.first("payload").alias("payload"), F.count(F.lit(1)).alias("attempts"), F.bool_or("delivered").alias("ok"),
    ).filter("NOT ok").drop("ok")


def retry_events(spark: SparkSession, send: Sender, outcomes: str) -> None:
    """Send what is outstanding once more."""
    deliver_events(outstanding(spark, outcomes).select("event_id", "payload"), send, outcomes)
