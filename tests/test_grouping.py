"""Batches, limits, alerts, events, counters, routing."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import batches as B
from emberline.operators import detect as D
from emberline.operators import events as E
from emberline.operators import limits as L
from emberline.operators.alerts import inactivity
from emberline.operators.metrics import metrics_rows, source_metrics
from emberline.plans.flow import issues_to_events
from tests.folds import batch_anchors, limiter

LINES = "source string, line_no long, line string, ts double, ts_str string, n_bytes long"


def issues(spark, stamps, size=10, source="s"):
    rows = [(source, i, f"line {i}".ljust(size)[:size], float(t), str(t), size) for i, t in enumerate(stamps)]
    return spark.createDataFrame(rows, LINES)


def lines_of(batches):
    return [r.n_lines for r in batches.orderBy("source", "batch_id").collect()]


@pytest.mark.parametrize("stamps,want", [
    ([100, 101, 106, 107], [2, 2]),
    ([100, 105, 105.1], [2, 1]),            # exactly five seconds still joins
    ([100, 0, 104, 0, 106], [4, 1]),        # unstamped lines join
    ([100, 90, 104, 106], [3, 1]),          # earlier ones too
    ([0, 3, 5, 6], [3, 1]),                 # an unstamped first line starts at zero
    ([0, 100, 101], [1, 2]),
    ([100], [1]),
])
def test_window(spark, stamps, want):
    assert lines_of(B.group_batches(issues(spark, stamps))) == want
    assert lines_of(B.group_batches(issues(spark, stamps), lazy=True)) == want


def test_byte_cap(spark):
    assert lines_of(B.group_batches(issues(spark, [5, 5, 5], size=100 * 1024))) == [2, 1]


def test_line_cap(spark):
    assert lines_of(B.group_batches(issues(spark, [7.0] * 2500))) == [1000, 1000, 500]


def test_message_and_first_line(spark):
    row = B.group_batches(issues(spark, [1, 2, 3], size=6)).first()
    assert row.message == "line 0\nline 1\nline 2" and row.n_bytes == len(row.message)
    assert (row.first_line_no, row.last_line_no, row.start_ts, row.ts_str, row.first_line) == (0, 2, 1.0, "1", "line 0")


def test_many_blocks_equal_walk(spark):
    rng = random.Random(3)
    rows = []
    for source, n in (("hot", 1500), ("x", 40)):
        t = 50.0
        for i in range(n):
            t += rng.choice([0, 0, 1, 2, 8])
            size = rng.randint(1, 12)
            rows.append((source, i * 7, "y" * size, rng.choice([t, 0.0, t - 9]), "", size))
    df = spark.createDataFrame(rows, LINES)
    for plan in ({"block_rows": 64, "fan": 3, "spans": (700, 5)}, {"block_rows": 64, "fan": 1000}, {}):
        got = B.assign_batches(df, 5.0, 9, 60, largest=None if "spans" in plan else 1500, **plan).collect()
        for source in ("hot", "x"):
            mine = [(r[3], r[5]) for r in rows if r[0] == source]
            out = [r.batch_id for r in sorted((r for r in got if r.source == source), key=lambda r: r.line_no)]
            assert out == batch_anchors(mine, 5.0, 9, 60)


def test_empty_messages(spark):
    rows = [("s", 0, "", 1.0, "", 0), ("s", 1, "x", 100.0, "", 1), ("s", 2, "", 200.0, "", 0)]
    df = spark.createDataFrame(rows, LINES)
    sent = B.sendable(B.group_batches(df), df).orderBy("batch_id").collect()
    assert [r.message for r in sent] == ["x", ""]


def test_count_only_and_timestamp_groups(spark):
    assert lines_of(B.batches_by_count(issues(spark, range(7)), max_lines=3)) == [3, 3, 1]
    text = ["[1.0] a", "[1.0] b", "[2.0] c", "[2.0] d", "[3.0] e", "[1.0] f"]
    df = spark.createDataFrame([("s", i, t, 0.0, "", 1) for i, t in enumerate(text)], LINES)
    got = {(r.ts_key, r.part): (r.line_count, r.lines) for r in B.group_by_timestamp(df, flush_lines=2).collect()}
    assert got == {("1.0", 0): (2, ["[1.0] a", "[1.0] b"]), ("1.0", 1): (1, ["[1.0] f"]),
                   ("2.0", 0): (2, ["[2.0] c", "[2.0] d"]), ("3.0", 0): (1, ["[3.0] e"])}


def clocked(spark, rows):
    return spark.createDataFrame(rows, "source string, batch_id long, start_ts double")


def passed(df):
    return [r.passed for r in df.orderBy("source", "batch_id").collect()]


def test_limiter_cases(spark):
    three = clocked(spark, [("s", i, 10.0 + i * 0.1) for i in range(3)])
    assert passed(L.rate_limit(three, 2, 1.0)) == [True, True, False]
    assert passed(L.rate_limit(three, 0, 1.0)) == [True, True, True]
    assert passed(L.rate_limit(three, 1, 0.0)) == [True, True, True]
    five = clocked(spark, [("s", i, 10.0) for i in range(5)])
    assert passed(L.rate_limit(five, 2)) == [True, True, False, False, False]
    edge = clocked(spark, [("s", 0, 10.0), ("s", 1, 11.0), ("s", 2, 11.000001)])
    assert passed(L.rate_limit(edge, 1, 1.0)) == [True, False, True]


def test_limiter_window_text(value):
    assert value(lambda c: L.limiter_window(F.col(c)), ["1m", "", None, "bad", "500ms"]) == [60.0, 1.0, 1.0, 0.0, 0.5]


@pytest.mark.parametrize("plan", [{}, {"lazy": True, "block_rows": 16, "fan": 3, "spans": (40, 5)}])
def test_limiter_equals_walk(spark, plan):
    rng = random.Random(11)
    rows, clock = [], 0.0
    for i in range(1200):
        clock += rng.choice([0, 0, 0.25, 0.5, 3])
        rows.append((rng.choice(["hot", "hot", "x"]), i, clock - rng.choice([0, 0, 0, 2])))
    got = L.rate_limit(clocked(spark, rows), 3, 2.0, **plan).collect()
    for source in ("hot", "x"):
        mine = [r for r in rows if r[0] == source]
        out = [r.passed for r in sorted((r for r in got if r.source == source), key=lambda r: r.batch_id)]
        assert out == limiter([r[2] for r in mine], 3, 2.0)


def test_limiter_continues_from_state(spark):
    rng = random.Random(4)
    clock, rows = 0.0, []
    for i in range(300):
        clock += rng.choice([0, 0.5, 1, 5])
        rows.append((rng.choice("ab"), i, clock))
    whole = {(r.source, r.batch_id): r.passed for r in L.rate_limit(clocked(spark, rows), 2, 3.0).collect()}
    seed, parts = None, {}
    for cut in ((0, 120), (120, 121), (121, 300)):
        df = clocked(spark, rows[slice(*cut)])
        parts.update({(r.source, r.batch_id): r.passed for r in L.rate_limit(df, 2, 3.0, seed=seed).collect()})
        state = L.limiter_state(df, 2, 3.0, seed=seed).collect()
        seed = spark.createDataFrame(state, "source string, opened_us long, used long")
    assert parts == whole


def test_inactivity(spark):
    rows = [("a", 0, 0.0), ("a", 1, 10.0), ("a", 2, 100.0), ("b", 0, 5.0), ("c", 0, 115.0)]
    df = spark.createDataFrame(rows, "source string, line_no long, ts double")
    got = [(r.source, r.level, r["at"]) for r in inactivity(df, 20.0, as_of=121.0).orderBy("source", "at").collect()]
    assert got == [("a", "warning", 30.0), ("a", "info", 100.0), ("a", "warning", 120.0), ("b", "warning", 25.0)]
    exact = inactivity(df, 90.0).collect()
    assert exact == []


def test_events(spark):
    rows = [("s", 0, "<34>Oct 11 22:14:15 host su: failed", 1.0, "Oct 11 22:14:15", 35)]
    event = E.build_events(B.group_batches(spark.createDataFrame(rows, LINES))).first()
    assert event.level == "fatal" and event.extra.raw_line == event.message
    assert event.tags == {"source": "s", "log_timestamp": "Oct 11 22:14:15", "syslog_priority": "34",
                          "syslog_facility": "4", "syslog_severity": "2"}
    detector = D.json_detector("msg:.*")
    objects = spark.createDataFrame([("s", 0, '{"level":"warning","msg":"x"}')], "source string, line_no long, line string")
    event = E.build_events(B.group_batches(D.matched_lines(objects, detector)), detector).first()
    assert event.level == "warning" and event.contexts.log_data == '{"level":"warning","msg":"x"}'
    assert event.tags == {"source": "s"}


def test_payload(spark):
    import json

    groups = spark.createDataFrame([("s", "1.0", 2, ['a "q"', "b\\"])], "source string, ts_key string, line_count long, lines array<string>")
    body = json.loads(E.payload_json(groups, "prod", F.struct(F.lit(3).alias("uptime"))).first().payload)
    assert body == {"message": "Log errors at timestamp [1.0]", "level": "error", "environment": "prod",
                    "tags": {"timestamp": "1.0", "source": "s"},
                    "extra": {"log_lines": {"timestamp": "1.0", "line_count": 2, "lines": 'a "q"\nb\\'}},
                    "contexts": {"Server State": {"uptime": 3}}}


def test_routing(spark):
    events = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "monitor string")
    monitors = spark.createDataFrame(
        [("a", "https://k@h/1", "", "r2"), ("b", "", "ignored", "ignored"), ("c", "https://k@h/3", "stage", None)],
        "name string, dsn string, environment string, release string")
    got = {r.monitor: (r.dsn, r.environment, r.release) for r in E.route(events, monitors, "G", "prod", "v1").collect()}
    assert got == {"a": ("https://k@h/1", "prod", "r2"), "b": ("G", "prod", "v1"), "c": ("https://k@h/3", "stage", "v1"),
                   "d": ("G", "prod", "v1")}


def test_counters(spark):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(["error a", "error skip", "ok", "error b"])],
                               "source string, line_no long, line string")
    marked = D.mark_excluded(D.mark_detected(df, D.generic_detector("error")), "skip")
    limited = clocked(spark, [("s", 0, 1.0), ("s", 1, 1.0)]).withColumn("passed", F.col("batch_id") == 0)
    wide = source_metrics(marked, limited)
    assert wide.first().asDict() == {"source": "s", "processed_lines": 4, "matched": 3, "excluded": 1,
                                     "issues_detected": 2, "events": 2, "events_sent": 1, "events_dropped": 1}
    rows = {(r.metric, r.status): r.value for r in metrics_rows(wide).collect()}
    assert rows["events_total", "dropped"] == 1.0 and rows["processed_lines_total", ""] == 4.0


def test_whole_flow(spark):
    monitors = [{"name": "web", "format": "nginx", "dsn": "https://k@h/1", "rate_limit_burst": 1},
                {"name": "api", "format": "json", "pattern": "level:fatal"}]
    rows = [("web", "web", i, f"2024/01/27 10:00:{s:02d} [error] n{i}") for i, s in enumerate([0, 3, 6, 30])]
    rows += [("api", "api", 0, '{"level":"fatal","msg":"m"}')]
    df = spark.createDataFrame(rows, "monitor string, source string, line_no long, line string")
    got = issues_to_events(df, {"dsn": "G", "environment": "prod", "release": "v"}, monitors).orderBy("source", "batch_id")
    out = [(r.source, r.n_lines, r.level, r.dsn, r.passed) for r in got.collect()]
    assert out == [("api", 1, "fatal", "G", True), ("web", 2, "info", "https://k@h/1", True),
                   ("web", 1, "info", "https://k@h/1", True), ("web", 1, "info", "https://k@h/1", True)]
