"""Event sinks, dead letters and redelivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.text import parse_dsn
from emberline.plans.storage import cut

Sender = Callable[[str], bool]


def tenant_key() -> Column:
    """Folder name of an address, without its secret."""
    parts = parse_dsn("dsn")
    return F.coalesce(F.concat_ws("_", parts["host"], parts["project_id"]), F.lit("default"))


def write_events(events: DataFrame, path: str, format: str = "parquet", mode: str = "append") -> None:
    """Write events, one folder per tenant when they are routed."""
    if "dsn" not in events.columns:
        events.write.mode(mode).format(format).save(path)
        return
    tenants = events.withColumn("tenant", tenant_key()).drop("dsn")
    tenants.write.mode(mode).partitionBy("tenant").format(format).save(path)


def read_events(spark: SparkSession, path: str, format: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema else reader).load(path)


def _attempt(send: Sender):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for payload in pdf["payload"]:
                try:
                    done.append(bool(send(payload)))
                except Exception:  # noqa: BLE001 - any failure of a sender means "not delivered"
                    done.append(False)
            yield pdf.assign(delivered=done)

    return run


def deliver(payloads: DataFrame, send: Sender) -> DataFrame:
    """Send ``(event_id, payload)`` rows from the tasks; adds ``delivered``.

    The outcome is written to the shared folder once before it is read, so that no
    event is sent again because a later step asks for it twice. A task that is lost
    may send its events again; the event id tells repeats apart.
    """
    narrow = payloads.select("event_id", "payload")
    tried = narrow.mapInPandas(_attempt(send), "event_id string, payload string, delivered boolean")
    return cut(tried)


def write_with_dlq(payloads: DataFrame, send: Sender, receipts: str, dlq: str) -> None:
    """Send events; failed ones go to ``dlq``, then ids of delivered ones to ``receipts``, so that a crash
    between the two loses no failed event. See ``sources.delivery`` for one table of both."""
    outcome = deliver(payloads, send)
    outcome.filter("NOT delivered").select("event_id", "payload").write.mode("append").parquet(dlq)
    outcome.filter("delivered").select("event_id").write.mode("append").parquet(receipts)


def pending(dead_letters: DataFrame, delivered: DataFrame) -> DataFrame:
    """Dead letters not yet delivered, each once."""
    return dead_letters.join(delivered.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])


def retry_dlq(spark: SparkSession, send: Sender, receipts: str, dlq: str) -> None:
    """Try every pending dead letter again and record the ones that got through."""
    shape = "event_id string"
    letters = spark.read.schema(f"{shape}, payload string").parquet(dlq)
    outcome = deliver(pending(letters, spark.read.schema(shape).parquet(receipts)), send)
    outcome.filter("delivered").select("event_id").write.mode("append").parquet(receipts)
