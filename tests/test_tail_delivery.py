"""Files that grow, rotate and are cut short; outcomes of sending."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from emberline.plans.flow import issues_to_events
from emberline.sources import delivery, tail, text
from emberline.streaming.monitors import MonitorStream


def positions(reader, start):
    """One micro-batch of a reader without Spark: its rows and its offset."""
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
    reader.commit(end)
    return sorted(rows, key=lambda r: (r["source"], r["line_no"])), end


@pytest.fixture
def follow(tmp_path):
    log = tmp_path / "logs" / "app.log"
    log.parent.mkdir()

    def make(path=None, **options):
        return tail.TailReader({"path": str(path or log), "name": "app", "journal": str(tmp_path / "journal.json"), **options})

    return log, make


def test_appends_rotation_truncation(follow):
    log, make = follow
    log.write_bytes(b"before\nhalf")
    reader = make()
    at = reader.initialOffset()

    def step(reader=reader):
        nonlocal at
        rows, at = positions(reader, at)
        return [(r["source"], r["line"]) for r in rows]

    assert step() == []
    with log.open("ab") as f:
        f.write(b" line\nnew\r\nun")
    assert step() == [("app", " line"), ("app", "new")]
    with log.open("ab") as f:
        f.write(b"finished\nlast without end")
    os.rename(log, log.with_suffix(".log.1"))
    assert step() == [("app", "unfinished")]
    log.write_bytes(b"fresh\n")
    assert step() == [("app", "last without end"), ("app", "fresh")]
    log.write_bytes(b"cut\n")  # shorter, in place
    assert step() == [("app", "cut")]
    log.write_bytes(b"longer than it was before\n")  # another beginning
    assert step() == [("app", "longer than it was before")]
    log.unlink()
    assert step() == []
    log.write_bytes(b"back\n")
    assert step() == [("app", "back")]
    # A new reader goes on from the journal.
    with log.open("ab") as f:
        f.write(b"after a restart\n")
    assert step(make()) == [("app", "after a restart")]


def test_batch_is_read_again_after_a_rotation(follow):
    log, make = follow
    log.write_bytes(b"")
    reader = make(start="beginning")
    start = reader.initialOffset()
    log.write_bytes(b"one\ntwo\n")
    end = reader.latestOffset()
    os.rename(log, log.parent / "app.log.old")
    log.write_bytes(b"three\n")
    later = make()  # the batch was planned, not committed
    later.latestOffset()
    rows = [r["line"] for p in later.partitions(start, end) for b in later.read(p) for r in b.to_pylist()]
    assert rows == ["one", "two"]
    (log.parent / "app.log.old").unlink()
    with pytest.raises(FileNotFoundError):
        [list(later.read(p)) for p in later.partitions(start, end)]
    lossy = make(failondataloss="false")
    assert [list(lossy.read(p)) for p in lossy.partitions(start, end)] == [[]]


def test_positions_and_limits(follow):
    """Positions rise over all files; any split and limit gives the same rows."""
    log, make = follow
    rng = random.Random(3)
    log.write_bytes(b"")
    reader = make(start="beginning", split="7", piece="5", maxbytes="20")
    at, got, want = reader.initialOffset(), [], []
    for step in range(40):
        if step % 9 == 8:
            os.rename(log, log.parent / f"app.log.{step}")
            log.write_bytes(b"")
        lines = ["".join(rng.choice("ab é漢") for _ in range(rng.choice([0, 1, 3, 30]))) for _ in range(rng.randint(0, 4))]
        want += lines
        with log.open("ab") as f:
            f.write("".join(f"{x}\n" for x in lines).encode())
        rows, at = positions(reader, at)
        got += rows
    for _ in range(60):
        rows, at = positions(reader, at)
        got += rows
    assert [r["line_no"] for r in got] == sorted({r["line_no"] for r in got})
    whole = []
    for r in got:
        assert len(r["line"].encode()) <= 5 + 3
        if r["piece"]:
            whole[-1] += r["line"]
        else:
            whole.append(r["line"])
    assert whole == want


def test_patterns(follow):
    log, make = follow
    log.write_bytes(b"old\n")
    reader = make(path=log.parent / "*.log*")
    at = reader.initialOffset()
    (log.parent / "b.log").write_bytes(b"b1\n")
    os.rename(log, log.parent / "app.log.1")
    log.write_bytes(b"new\n")
    rows, at = positions(reader, at)
    assert sorted((os.path.basename(r["source"]), r["line"]) for r in rows) == [("app.log", "new"), ("b.log", "b1")]


def test_stream_into_monitors(spark, tmp_path):
    """Appended and rotated files through the whole flow: equal to the batch flow over the same lines."""
    log = tmp_path / "app.log"
    log.write_text("")
    monitors = [{"name": "app", "pattern": "Error"}]
    flow = MonitorStream(spark, {"dsn": "G"}, monitors, idle=None, line_clock=True)
    stream = text.tail_lines(spark, str(log), "app", str(tmp_path / "journal"), start="beginning")
    every = []

    def run(*lines):
        every.extend(lines)
        with log.open("a") as f:
            f.write("".join(f"{x}\n" for x in lines))
        flow.start(stream, str(tmp_path / "events"), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()

    run("[1.0] Error", "fine", "[2.0] Error")
    os.rename(log, tmp_path / "app.log.1")
    run("[3.0] Error", "[20.0] Error")
    run("[21.0] Error", "[21.0] Error", "[50.0] Error")
    events = spark.read.parquet(str(tmp_path / "events")).drop("epoch").unionByName(flow.drain(str(tmp_path / "checkpoint")))
    at, rows = 0, []
    for line in every:
        rows.append(("app", "app", at, line))
        at += len(line) + 1
    whole = issues_to_events(spark.createDataFrame(rows, "monitor string, source string, line_no long, line string"), {"dsn": "G"}, monitors)
    key = lambda df: sorted((r.event_id, r.first_line_no, r.message) for r in df.collect())
    assert key(events) == key(whole) and events.count() == 3


def test_outcomes(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), json.dumps({"n": i})) for i in range(9)] + [("1", json.dumps({"n": 1}))], "event_id string, payload string")
    outcomes, log = str(tmp_path / "outcomes"), str(tmp_path / "log")

    def flaky(payload):
        with open(log, "a") as f:
            f.write(payload + "\n")
        if json.loads(payload)["n"] % 3 == 1:
            raise OSError("unreachable")
        return json.loads(payload)["n"] % 3 == 0

    delivery.deliver_events(rows, flaky, outcomes)
    assert len(open(log).readlines()) == 9
    left = lambda: {r.event_id: r.attempts for r in delivery.outstanding(spark, outcomes).collect()}
    assert left() == {i: 1 for i in "124578"}
    assert {r.error for r in delivery.read_outcomes(spark, outcomes).collect()} == {None, "OSError: unreachable"}
    delivery.retry_events(spark, lambda p: json.loads(p)["n"] < 5, outcomes)
    assert left() == {i: 2 for i in "578"}
    delivery.deliver_events(rows, flaky, outcomes)  # delivered ones aren't sent again
    assert left() == {i: 3 for i in "578"} and len(open(log).readlines()) == 12


def test_crash_between_sending_and_commit(spark, tmp_path):
    """A task that fails after sending leaves no outcome of its own, so its events are still to be sent."""
    rows = spark.createDataFrame([(str(i), str(i)) for i in range(8)], "event_id string, payload string").repartition(4, "event_id")
    outcomes = str(tmp_path / "outcomes")

    class Gone(BaseException):
        pass

    def crashing(payload):
        if payload == "3":
            raise Gone
        return True

    with pytest.raises(Exception, match="Gone"):
        delivery.deliver_events(rows, crashing, outcomes)
    sent = {r.event_id for r in delivery.read_outcomes(spark, outcomes).filter("delivered").collect()}
    assert "3" not in sent
    delivery.deliver_events(rows, lambda p: True, outcomes)
    found = delivery.read_outcomes(spark, outcomes).groupBy("event_id").agg(F.count("*").alias("n")).collect()
    assert {r.event_id for r in found} == {str(i) for i in range(8)}


def test_stream_of_events(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), str(i)) for i in range(6)], "event_id string, payload string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    outcomes = str(tmp_path / "outcomes")
    delivery.stream_events(stream, lambda p: int(p) % 2 == 0, outcomes, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    assert {r.event_id for r in delivery.outstanding(spark, outcomes).collect()} == {"1", "3", "5"}
    delivery.retry_events(spark, lambda p: True, outcomes)
    assert delivery.outstanding(spark, outcomes).count() == 0
