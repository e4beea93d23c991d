"""Files, payloads, sinks, dead letters, generated logs and streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from emberline.operators import detect as D
from emberline.sources import generate as G
from emberline.sources import sinks, text
from emberline.streaming.issues import IssueStream
from emberline.streaming.silence import watch_inactivity


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rstill two\n\nlast")
    (tmp_path / "b.log").write_bytes(b"x\n" + b"y" * text.MAX_LINE_BYTES + b"\nz\n")
    one = text.read_lines(spark, str(tmp_path / "a.log"), "app").orderBy("line_no").collect()
    assert [(r.source, r.line) for r in one] == [("app", "one"), ("app", "two\rstill two"), ("app", ""), ("app", "last")]
    both = text.read_lines(spark, str(tmp_path / "*.log"), "app")
    assert {r.source for r in both.collect()} == {f"app:{tmp_path}/a.log", f"app:{tmp_path}/b.log"}
    assert [r.line for r in both.filter("source LIKE '%b.log'").orderBy("line_no").collect()] == ["x", "z"]
    assert [len(r.line) for r in text.read_rejected(spark, str(tmp_path / "*.log"), "app").collect()] == [text.MAX_LINE_BYTES]


def test_order_over_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"{i}\r\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = text.read_lines(spark, str(tmp_path / "big.log"), "app")
        assert df.rdd.getNumPartitions() > 5
        assert [r.line for r in df.orderBy("line_no").collect()] == [str(i) for i in range(20000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_read_monitors(spark, tmp_path):
    (tmp_path / "k.txt").write_text("[1.0] a: fail\n")
    (tmp_path / "w.txt").write_text("x\ny\n")
    monitors = [{"name": "k", "type": "dmesg", "path": str(tmp_path / "k.txt")}, {"name": "w", "type": "file", "path": str(tmp_path / "w.txt")}]
    assert sorted((r.monitor, r.line) for r in text.read_monitors(spark, monitors).collect()) == [
        ("k", "[1.0] a: fail"), ("w", "x"), ("w", "y")]


def test_split_payload(spark):
    df = spark.createDataFrame([("s", 0, "a\r\n\nb"), ("s", 1, "c\n")], "source string, seq long, payload string")
    assert [r.line for r in text.split_payload(df).orderBy("line_no").collect()] == ["a", "b", "c"]
    assert [r.line for r in text.split_payload(df, keep_empty=True).orderBy("line_no").collect()] == ["a", "", "b", "c"]


def test_sinks(spark, tmp_path):
    events = spark.createDataFrame([("1", "https://k@h/7"), ("2", "https://k@h/8")], "event_id string, dsn string")
    for fmt in ("parquet", "json"):
        sinks.write_events(events, str(tmp_path / fmt), format=fmt)
        assert {(r.event_id, r.tenant) for r in sinks.read_events(spark, str(tmp_path / fmt), fmt).collect()} == {
            (1 if fmt == "x" else "1", "h_7"), ("2", "h_8")}
        assert sorted(d for d in os.listdir(tmp_path / fmt) if d.startswith("tenant")) == ["tenant=h_7", "tenant=h_8"]


def test_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), json.dumps({"n": i})) for i in range(6)], "event_id string, payload string")
    receipts, dlq, log = str(tmp_path / "ok"), str(tmp_path / "dlq"), str(tmp_path / "log")

    def flaky(payload):
        with open(log, "a") as f:
            f.write(payload + "\n")
        if json.loads(payload)["n"] % 2:
            raise OSError("unreachable")
        return True

    sinks.write_with_dlq(rows, flaky, receipts, dlq)
    assert len(open(log).readlines()) == 6  # each event tried once
    left = lambda: {r.event_id for r in sinks.pending(spark.read.parquet(dlq), spark.read.parquet(receipts)).collect()}
    assert left() == {"1", "3", "5"}
    sinks.retry_dlq(spark, lambda p: json.loads(p)["n"] != 3, receipts, dlq)
    assert left() == {"3"}
    sinks.retry_dlq(spark, lambda p: True, receipts, dlq)
    assert left() == set()


def test_generate(spark):
    lines = [r.line for r in G.generate_logs(spark, 400, "nginx", error_rate=50, seed=1).collect()]
    again = [r.line for r in G.generate_logs(spark, 400, "nginx", error_rate=50, seed=1, partitions=3).orderBy("line_no").collect()]
    assert sorted(lines) == sorted(again)
    bad = sum(any(f"[{v}]" in x for v in G.NGINX_LEVELS[2:]) for x in lines)
    assert 140 < bad < 260 and all(x.startswith("2024/01/01 00:00:00 [") for x in lines)
    kernel = [r.line for r in G.generate_logs(spark, 400, "dmesg", 10.0).collect()]
    assert 15 < sum(x.startswith(" ") for x in kernel) < 75
    assert all("refused the connection" in r.line for r in G.generate_logs(spark, 5, "nginx-error").collect())
    sized = G.generate_bytes(spark, 20000, "dmesg").agg(F.sum(F.length("line") + 1), F.max("line_no"), F.count("*")).first()
    assert 20000 <= sized[0] < 20200 and sized[1] + 1 == sized[2]
    with pytest.raises(ValueError):
        G.generate_logs(spark, 1, "xml")


def test_idle_flush_and_drain(spark, tmp_path):
    flow = IssueStream(spark, D.generic_detector("E"), str(tmp_path))

    def send(epoch, now, *lines):
        rows = [("s", i, x) for i, x in enumerate(lines)]
        df = spark.createDataFrame(rows, "source string, line_no long, line string")
        return [r.message for r in flow.events(df, epoch, now=now).orderBy("batch_id").collect()]

    assert send(0, 100.0, "E1 [x]", "ok", "E2") == []
    assert send(1, 102.0, "E3") == []                      # still open, joined
    assert send(2, 104.0) == []                            # touched at 102
    assert send(3, 107.5, "E4") == ["E1 [x]\nE2\nE3"]      # idle for 5.5 s: E4 starts anew
    assert send(4, 108.0, "[1.0] E5", "[9.0] E6") == ["E4\n[1.0] E5"]
    assert [r.message for r in flow.drain(4).collect()] == ["[9.0] E6"]


def test_rerun_of_an_epoch_gives_the_same(spark, tmp_path):
    flow = IssueStream(spark, D.generic_detector("E"), str(tmp_path), idle=None, burst=1, limit_window=100.0)
    make = lambda *lines: spark.createDataFrame(
        [("s", i, x) for i, x in enumerate(lines)], "source string, line_no long, line string")
    flow.events(make("[1.0] E", "[50.0] E"), 0).collect()
    first = sorted(map(str, flow.events(make("[60.0] E", "[90.0] E"), 1).collect()))
    assert first == sorted(map(str, flow.events(make("[60.0] E", "[90.0] E"), 1).collect()))
    assert len(first) == 2


def test_rotated_files(spark, tmp_path):
    """Files moved into a folder are read once each, in full, as they come."""
    folder, sink = tmp_path / "logs", str(tmp_path / "events")
    folder.mkdir()
    (folder / "old.log").write_text("Error before the start\n")
    os.utime(folder / "old.log", (1, 1))
    flow = IssueStream(spark, D.generic_detector("Error"), str(tmp_path / "state"), idle=None)
    stream = text.stream_lines(spark, str(folder), "app", max_files=1, since=1000.0)

    def run():
        query = flow.start(stream, sink, str(tmp_path / "checkpoint"), number=text.number_lines, available_now=True)
        query.awaitTermination()
        return query.lastProgress["batchId"]

    (folder / "a.log").write_text("Error 1\nfine\n")
    run()
    (folder / "b.log").write_text("Error 2\nError 3\n")
    last = run()
    flow.drain(last, sink)
    got = {(r.source.rsplit("/", 1)[1], r.message) for r in spark.read.parquet(sink).collect()}
    assert got == {("a.log", "Error 1"), ("b.log", "Error 2\nError 3")}


def test_wall_clock_inactivity(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.txt").write_text("hello\n")
    stream = spark.readStream.text(str(folder)).select(F.lit("src").alias("source"))
    query = (
        watch_inactivity(stream, 2.0).writeStream.format("memory").queryName("silence").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        rows = lambda: [r.level for r in spark.sql("SELECT * FROM silence ORDER BY at").collect()]
        deadline = time.time() + 60
        while rows() != ["warning"] and time.time() < deadline:
            time.sleep(0.5)
        assert rows() == ["warning"]
        (folder / "1.txt").write_text("again\n")
        while len(rows()) < 2 and time.time() < deadline:
            time.sleep(0.5)
        assert rows()[:2] == ["warning", "info"]
    finally:
        query.stop()
