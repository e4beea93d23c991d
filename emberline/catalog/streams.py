"""The streaming flow over the event table, fed as a series of files; results must
equal the batch operators'."""

from pyspark.sql import functions as F

from emberline.catalog import Catalog
from emberline.catalog.common import lines, windows_sql
from emberline.catalog.grouping import CATALOG as GROUPING, FLOW_MONITORS, FLOW_TENANT
from emberline.operators.detect import detector_for
from emberline.plans.fixtures import epoch_seconds
from emberline.plans.storage import new_path
from emberline.streaming.issues import IssueStream
from emberline.streaming.monitors import MonitorStream, unique_lines
from emberline.streaming.silence import SilenceStream

CATALOG = Catalog()
add = CATALOG.add

EPOCHS = 3
FILES_PER_EPOCH = 4
LINES = "source string, line_no long, line string"


def feed(spark, df, path, schema):
    """The lines as files in order of ``line_no``, then as a stream of some files per trigger."""
    top = df.agg(F.max("line_no")).first()[0]
    for epoch in range(EPOCHS):
        piece = df.filter(F.floor(F.col("line_no") * EPOCHS / (top + 1)) == epoch)
        piece.repartition(FILES_PER_EPOCH).write.parquet(f"{path}/in/part={epoch}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_EPOCH)
        .option("recursiveFileLookup", "true").parquet(f"{path}/in")
    )


def run(spark, sf, fmt, **options):
    path = new_path(spark, "stream")
    stream = feed(spark, lines(spark, sf, fmt), path, LINES)
    flow = IssueStream(spark, detector_for(fmt), f"{path}/state", idle=None, **options)
    query = flow.start(stream, f"{path}/events", f"{path}/checkpoint", available_now=True)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    flow.drain(last, f"{path}/events")
    return spark.read.parquet(f"{path}/events")


EVENT_SELECT = "SELECT source, first_line_no, n_lines, message FROM b"


def batch_part(name):
    return GROUPING.sql[name].rsplit("SELECT source, batch_id", 1)[0]


@add("stream_batches", batch_part("batch_anchored") + EVENT_SELECT)
def stream_batches(spark, sf):
    return run(spark, sf, "nginx", window=3600.0).select("source", "first_line_no", "n_lines", "message")


@add("stream_dmesg", batch_part("batch_dmesg") + EVENT_SELECT)
def stream_dmesg(spark, sf):
    return run(spark, sf, "dmesg", window=7200.0).select("source", "first_line_no", "n_lines", "message")


@add("stream_rate_limit", batch_part("batch_anchored") + f""",
{windows_sql("SELECT source, batch_id AS ord, start_ts AS t FROM b", 21600)}
SELECT b.source, first_line_no, pos < 2 AS passed FROM lim JOIN b ON b.source = lim.source AND b.batch_id = lim.ord""")
def stream_rate_limit(spark, sf):
    events = run(spark, sf, "nginx", window=3600.0, burst=2, limit_window=21600.0)
    return events.select("source", "first_line_no", "passed")


@add("stream_inactivity", GROUPING.sql["inactivity_alerts"].replace("coalesce(til, 1706745600) - since > 1800", "til - since > 1800"))
def stream_inactivity(spark, sf):
    path = new_path(spark, "stream")
    seen = lines(spark, sf, "iso", "ts").select("source", "line_no", epoch_seconds().cast("double").alias("ts"))
    stream = feed(spark, seen, path, "source string, line_no long, ts double")
    flow = SilenceStream(spark, f"{path}/state", 1800.0)

    def body(batch, epoch):
        flow.alerts(batch, epoch).write.mode("overwrite").parquet(f"{path}/alerts/epoch={epoch}")

    query = (
        stream.writeStream.foreachBatch(body).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/alerts").select("source", "level", F.col("at").cast("bigint").alias("at"))


def run_monitors(spark, table, monitors, tenant, unique=False, **settings):
    """Events of a bounded stream of ``(monitor, source, line_no, line)``, those of the batches it left open included."""
    path = new_path(spark, "stream")
    flow = MonitorStream(spark, tenant, monitors, idle=None, line_clock=True, **settings)
    stream = feed(spark, table, path, f"monitor string, {LINES}")
    query = flow.start(unique_lines(stream) if unique else stream, f"{path}/events", f"{path}/checkpoint", available_now=True)
    query.awaitTermination()
    sent = spark.read.parquet(f"{path}/events").drop("epoch")
    return sent.unionByName(flow.drain(f"{path}/checkpoint"))


@add("stream_flow", GROUPING.sql["whole_flow"])
def stream_flow(spark, sf):
    raw = lines(spark, sf, "nginx").withColumn("monitor", F.col("source"))
    events = run_monitors(spark, raw, FLOW_MONITORS, FLOW_TENANT)
    return events.select("source", "batch_id", "dsn", "environment", "passed", F.col("start_ts").cast("bigint").alias("start_ts"))
