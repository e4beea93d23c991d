"""A run of a stream takes all there is, however many micro-batches that needs."""

import datetime
import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.streaming.readwriter import DataStreamWriter

from emberline.catalog import following
from emberline.plans import ordered


def test_each_run_follows_to_the_end(spark, tmp_path, monkeypatch):
    """One start of the query for each run, however many micro-batches its lines take."""
    n, starts, start = 20_000, [], DataStreamWriter.start
    pq.write_table(pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array([datetime.datetime(2024, 1, 5, 6, 7, 8)] * n, pa.timestamp("us")),
        "user_id": pa.array([4 * (i % 9) for i in range(n)], pa.int64()), "event_type": ["click"] * n}), tmp_path / "events.parquet")
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: starts.append(start(self, *a, **k)) or starts[-1])
    rows = following.stream_tail(spark, str(tmp_path)).collect()
    assert sorted((r.source, r.place, r.line) for r in rows) == [("src0", i + 1, f"2024-01-05 06:07:08 click user={4 * (i % 9)}") for i in range(n)]
    assert len(starts) == following.PARTS and all(len([p for p in q.recentProgress if p.numInputRows]) > 1 for q in starts)


def test_no_task_has_a_whole_source(spark, tmp_path, monkeypatch):
    """A log is written by several tasks, and the lines of a source are numbered by spans of it."""
    n = 6000
    monkeypatch.setattr(ordered, "PLAIN_ROWS", 1000)
    pq.write_table(pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array([datetime.datetime(2024, 1, 5, 6, 7, 8)] * n, pa.timestamp("us")),
        "user_id": pa.array([4 * (i % 9) for i in range(n)], pa.int64()), "event_type": [f"click{i}" for i in range(n)]}), tmp_path / "events.parquet")
    folders, make = [], following.local_folder
    monkeypatch.setattr(following, "local_folder", lambda *a: folders.append(make(*a)) or folders[-1])
    rows = following.stream_tail(spark, str(tmp_path))
    assert all(len(glob.glob(os.path.join(folders[0], "made", f"part={k}", "source=src0", "*.txt"))) > 1 for k in range(following.PARTS))
    got = rows.collect()
    assert sorted((r.source, r.place, r.line) for r in got) == [("src0", i + 1, f"2024-01-05 06:07:08 click{i} user={4 * (i % 9)}") for i in range(n)]
    assert "_span" in rows._jdf.queryExecution().executedPlan().toString()
