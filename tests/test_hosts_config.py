"""Host snapshots, as-of attachment, monitor configuration."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import hosts as H
from emberline.operators import monitors as M
from emberline.plans.asof import asof_times

SAMPLES = ("host string, snapshot_ts double, pid int, utime long, stime long, starttime long, rss_pages long, uptime long,"
           " total_mem long, cmdline array<string>, comm string")


def test_snapshots(spark):
    rows = [("h", 60.0, p, p * 100, 0, 0, (20 - p) * 256, 1000, 64 << 20,
             ["srv", "--token", "x"] if p % 2 else [], None if p == 8 else f"c{p}") for p in range(1, 9)]
    row = H.snapshots(spark.createDataFrame(rows, SAMPLES)).first()
    assert [p.pid for p in row.top_cpu] == ["8", "7", "6", "5", "4"]
    assert [p.pid for p in row.top_mem] == ["1", "2", "3", "4", "5"]
    assert [p.command for p in row.top_cpu] == ["unknown", "srv --token [REDACTED]", "c6", "srv --token [REDACTED]", "c4"]
    assert (row.top_cpu[0].cpu, row.top_mem[0].mem, row.top_mem[0].rss) == ("0.8", "29.7", str(19 * 256 * 4096))
    assert row.process_summary == "Total Processes: 8"


def test_top_ties(spark):
    df = spark.createDataFrame([("h", 1.0, p, 5.0) for p in (9, 3, 7)], "host string, snapshot_ts double, pid int, v double")
    assert [r.pid for r in H.top_processes(df, "v", 2).orderBy("rank").collect()] == [3, 7]


def test_top_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("host"), (F.col("id") % 3).alias("snapshot_ts"),
                                 F.col("id").alias("pid"), F.rand(1).alias("v"))
    plan = H.top_processes(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("plan", [{}, {"bucket_seconds": 50.0, "salts": 3, "spans": (4, 3)}])
def test_asof_equals_search(spark, plan):
    rng = random.Random(8)
    left = [(rng.choice("ab"), i, float(rng.randint(-50, 5000))) for i in range(600)]
    right = sorted({("a", float(rng.choice([rng.randint(0, 300), rng.randint(4000, 5000)]))) for _ in range(60)} | {("b", 1000.0)})
    lhs = spark.createDataFrame(left, "host string, id long, t double")
    got = asof_times(lhs, spark.createDataFrame(right, "host string, t double"), "host", "t", **plan).collect()
    assert len(got) == len(left)
    for row in got:
        times = [t for h, t in right if h == row.host]
        i = bisect.bisect_right(times, row.t)
        assert row.matched_time == (times[i - 1] if i else None)


def test_attach(spark):
    events = spark.createDataFrame([("h", 1, 10.0), ("h", 2, 20.0), ("z", 3, 9.0)], "host string, id long, sent_ts double") \
        .withColumn("tags", F.create_map(F.lit("a"), F.lit("b")))
    states = spark.createDataFrame([("h", 15.0, "S")], "host string, snapshot_ts double, process_summary string")
    rows = H.attach_server_state(events, H.server_state(states)).orderBy("id").collect()
    assert [r.server_state and r.server_state.process_summary for r in rows] == [None, "S", None]


CONFIG = """
tenant:
  dsn: ""
  environment: staging
monitors:
  - name: web
    type: file
    path: /var/log/x
    format: nginx
    rate_limit_burst: 5
    tenant: {dsn: https://k@h/2}
  - name: cmd
    type: command
    args: run --password=x --token y
"""


def test_load(spark):
    tenant, table = M.load_monitors(spark, CONFIG, dsn="https://k@h/1", release="v1")
    assert tenant == {"dsn": "https://k@h/1", "environment": "staging", "release": "v1"}
    rows = {r.name: r for r in M.redact_monitors(table).collect()}
    assert rows["web"].dsn == "***" and rows["web"].rate_limit_burst == 5 and rows["cmd"].dsn == ""
    assert rows["cmd"].args == "run --password=[REDACTED] --token [REDACTED]"
    assert M.read_config("{}")[0]["environment"] == "production"


def monitor(**given):
    return {**{f: "" for f in M.TEXT_FIELDS}, "rate_limit_burst": 0, **given}


@pytest.mark.parametrize("given,want", [
    ({"format": "nginx"}, "nginx"), ({"type": "dmesg"}, "dmesg"), ({"type": "dmesg", "pattern": "x"}, "custom"),
    ({"type": "file"}, "custom"), ({"format": "nginx", "type": "dmesg", "pattern": "x"}, "nginx"),
    ({"name": "nginx", "type": "file"}, "nginx"), ({"name": "nginx-error"}, "nginx-error"), ({"name": "foobar"}, "custom"),
])
def test_formats(spark, given, want):
    assert M.format_of(given) == want
    df = spark.createDataFrame([monitor(**given)], M.SCHEMA)
    assert df.select(M.infer_format().alias("f")).first().f == want


ERRORS = [
    (dict(name="t", type="file", path="/x"), None),
    (dict(name="", type="file"), "without a name"),
    (dict(name="t", type="bad"), "no such monitor type: bad"),
    (dict(name="t", type="file"), "without a path"),
    (dict(name="t", type="command"), "a command monitor without a command"),
    (dict(name="t", type="dmesg", pattern="("), "pattern cannot be read"),
    (dict(name="t", type="dmesg", exclude_pattern="["), "exclude_pattern cannot be read"),
    (dict(name="t", type="dmesg", max_inactivity="invalid"), "max_inactivity is no duration"),
    (dict(name="t", type="dmesg", rate_limit_window="2days"), "rate_limit_window is no duration"),
    (dict(name="t", type="journalctl", pattern="(?i)x", max_inactivity="5m", rate_limit_window="1.5s"), None),
]


def test_validation(spark):
    df = spark.createDataFrame([monitor(args=str(i) if case.get("type") != "command" else "", **case)
                                for i, (case, _) in enumerate(ERRORS)], M.SCHEMA)
    got = df.coalesce(1).select(M.validation_error().alias("e")).collect()
    for row, (case, want) in zip(got, ERRORS):
        assert (row.e is None) == (want is None) and (want or "") in (row.e or ""), case
    none = spark.createDataFrame([], M.SCHEMA)
    assert {r.error for r in M.validate_config({"dsn": ""}, none).collect()} == {"an address (dsn) is missing", "nothing to monitor"}
