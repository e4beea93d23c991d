"""Monitors over a stream: the same events as the batch flow, and timers that fire by themselves."""

import random
import time

import pytest

from emberline.plans.flow import issues_to_events
from emberline.streaming.monitors import MonitorStream

LINES = "monitor string, source string, line_no long, line string"
TENANT = {"dsn": "https://g@h/0", "environment": "live", "release": "r"}
MONITORS = [
    {"name": "web", "format": "nginx", "dsn": "https://k@h/1", "rate_limit_burst": 2, "rate_limit_window": "30s", "exclude_pattern": "skip"},
    {"name": "kern", "type": "dmesg", "exclude_pattern": "harmless"},
    {"name": "api", "format": "json", "pattern": "level:fatal|error", "rate_limit_burst": 1, "rate_limit_window": "5s"},
    {"name": "twice", "pattern": "boom"},
    {"name": "twice", "pattern": "o+m!", "dsn": "https://k@h/2", "environment": "stage"},
    {"name": "never", "pattern": "x"},
]


def made_up(rng, n):
    rows, clock = [], 0
    for i in range(n):
        clock += rng.choice([0, 1, 2, 9, 40])
        rows.append(("web", rng.choice(["w1", "w2", None]), i, f"2024/01/27 10:{clock // 60 % 60:02d}:{clock % 60:02d} [{rng.choice(['error', 'info'])}] {rng.choice(['skip', 'take'])} {i}"))
        header = rng.choice(["ata1", "ata1.00", " usb", "eth0"])
        text = rng.choice(["link fail", "reset", "harmless error", "up"])
        rows.append(("kern", rng.choice(["k1", None]), i, rng.choice([f"[{clock}.5] {header}: {text} {i}", f" continued {i}", f"[{clock}.5] nothing here {i}", f"[0.0] {header}: {text}"])))
        rows.append(("api", "a", i, f'{{"level": "{rng.choice(["fatal", "error", "info"])}", "time": "2024-01-27T10:{clock // 60 % 60:02d}:{clock % 60:02d}Z", "n": {i}}}'))
        rows.append(("twice", "t", i, rng.choice(["boom! 1", "boom", "zoom!", "", f"[{clock}.0] boom!"])))
        rows.append(("unknown", "u", i, "boom! error"))
    return rows


def streamed(spark, rows, folder, parts, **settings):
    schema = LINES
    top = max(r[2] for r in rows) + 1
    for k in range(parts):
        piece = [r for r in rows if r[2] * parts // top == k]
        random.Random(k).shuffle(piece)
        spark.createDataFrame(piece, schema).repartition(2).write.parquet(f"{folder}/in/part={k}")
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    flow = MonitorStream(spark, TENANT, MONITORS, line_clock=True, idle=None, **settings)
    query = flow.start(lines, f"{folder}/events", f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/events").drop("epoch"), flow.drain(f"{folder}/checkpoint")


def told(events):
    columns = ["event_id", "source", "batch_id", "first_line_no", "start_ts", "n_lines", "message", "level", "tags", "extra", "contexts", "monitor", "dsn", "environment", "release", "passed"]
    return sorted(str(r) for r in events.select(*columns).collect())


def test_stream_equals_batch(spark, tmp_path):
    rows = made_up(random.Random(7), 150)
    sent, left = streamed(spark, rows, tmp_path, 3)
    whole = issues_to_events(spark.createDataFrame(rows, LINES), TENANT, MONITORS)
    got, want = told(sent.unionByName(left)), told(whole)
    assert got == want and len(want) > 60
    ids = [r.event_id for r in sent.unionByName(left).select("event_id").collect()]
    assert len(ids) == len(set(ids))


def test_two_monitors_of_one_name(spark):
    df = spark.createDataFrame([("twice", "t", 0, "boom!"), ("twice", "t", 1, "boom")], LINES)
    got = sorted((r.message, r.dsn) for r in issues_to_events(df, TENANT, MONITORS).collect())
    assert got == [("boom!", "https://k@h/2"), ("boom!\nboom", "https://g@h/0")]
    from pyspark.sql import functions as F

    own = issues_to_events(df.withColumn("monitor_no", F.lit(4)), TENANT, MONITORS)
    assert [(r.message, r.dsn, r.monitor) for r in own.collect()] == [("boom!", "https://k@h/2", "twice")]


@pytest.fixture
def waiting():
    def until(found, seconds=60):
        deadline = time.time() + seconds
        while time.time() < deadline:
            if found():
                return True
            time.sleep(0.3)
        return False

    return until


def test_timers(spark, tmp_path, waiting):
    """An idle batch and a source that never spoke come out with no further line."""
    monitors = [{"name": "app", "pattern": "Error", "max_inactivity": "3s"}, {"name": "mute", "pattern": "x", "path": "/var/log/mute.log", "max_inactivity": "1s"}]
    flow = MonitorStream(spark, TENANT, monitors, idle=1.0, ttl=3600.0)
    folder = tmp_path / "in"
    folder.mkdir()
    add = lambda name, *rows: spark.createDataFrame(list(rows), LINES).coalesce(1).write.parquet(str(folder / name))
    add("0", ("app", "a", 0, "Error 1"), ("app", "a", 1, "fine"), ("app", "a", 2, "Error 2"))
    lines = spark.readStream.schema(LINES).option("recursiveFileLookup", "true").parquet(str(folder))
    seen = []
    query = flow.start(lines, lambda events, epoch: seen.extend(events.collect()), str(tmp_path / "checkpoint"), every="300 milliseconds")
    try:
        assert waiting(lambda: any(r.n_lines == 2 for r in seen)), seen
        assert waiting(lambda: sum(r.level == "warning" for r in seen) == 2), seen
        assert {r.source: r.message for r in seen if r.level == "warning"} == {
            "mute": "mute: Monitor source inactivity detected (silence for 1s)", "a": "a: Monitor source inactivity detected (silence for 3s)"}
        batch = next(r for r in seen if r.n_lines)
        assert (batch.message, batch.monitor, batch.passed) == ("Error 1\nError 2", "app", True)
        add("1", ("app", "a", 3, "fine again"))
        assert waiting(lambda: any(r.message == "a: Monitor source activity resumed" for r in seen)), seen
        time.sleep(2)
        assert sum(r.source == "mute" for r in seen) == 1
        alert = next(r for r in seen if r.source == "mute")
        assert alert.tags == {"source": "mute", "alert_type": "inactivity"} and alert.dsn == TENANT["dsn"]
    finally:
        query.stop()
    assert len({r.event_id for r in seen}) == len(seen)
