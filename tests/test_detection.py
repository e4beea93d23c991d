"""Detectors, exclusion, kernel context, monitors."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import detect as D
from emberline.operators.context import context_state, mark_context
from tests.folds import dmesg_keep

DMESG = [
    "[ 11.250000] thermal: zone registered",
    "[ 12.500000] spi0: transfer Failed with code 5",
    "  while it waited for the clock",
    "  queue of 3 requests dropped",
    "[ 13.750000] thermal: zone at 41 degrees",
    "[ 14.125000] exception in interrupt handler",
    "[ 15.000000] audio: oops, stream lost",
    "[ 16.000000] audit: policy loaded",
    "[ 17.000000] wlan0: error while joining",
]
ATA = [
    "[5210.100000] port3.00: error reading sector 9",
    "[5210.100008] port3.00: status word 0x51",
    "[5210.100009] port3: link reset begins",
    "        command 7 of 12, tag 4",
    "[5210.900000] port3: speed renegotiated",
    "[5215.100009] port3.00: a little over five seconds on",
    "[9000.500000] gpu 0:2.0: clock changed",
    " without a stamp, so it goes on",
]


def kept(spark, lines, detector, exclude=None, **plan):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source string, line_no long, line string")
    return [r.line_no for r in D.matched_lines(df, detector, exclude, **plan).orderBy("line_no").collect()]


def test_dmesg_golden(spark):
    assert kept(spark, DMESG, D.dmesg_detector()) == [1, 2, 3, 5, 6, 8]
    assert kept(spark, ATA, D.dmesg_detector()) == [0, 1, 2, 3, 4, 7]


def test_excluded_lines_still_give_context(spark):
    assert kept(spark, ATA[:3], D.dmesg_detector(), exclude="reading") == [1, 2]


def test_nginx_and_json_golden(spark):
    levels = ["info", "error", "warn", "crit", "alert", "emerg", "notice"]
    lines = [f"2024/01/27 10:00:0{i} [{v}] 1#0: *{i} text" for i, v in enumerate(levels)]
    assert kept(spark, lines, D.detector_for("nginx")) == [1, 3, 4, 5]
    objects = ['{"level":"%s", "msg":"m"}' % v for v in ("info", "error", "debug", "error", "warning")]
    assert kept(spark, objects + ["level:error", "{"], D.detector_for("json", "level:error")) == [1, 3]


@pytest.mark.parametrize("pattern,lines,want", [
    ("Error", ["an Error", "an error"], [True, False]),
    ("(?i)error", ["an Error", "fine"], [True, False]),
    ("a.c", ["abc", "a.c", "ac"], [True, True, False]),
    ("(?P<x>[[:digit:]]+)$", ["n 12", "12 n"], [True, False]),
    ("[[:^alpha:]]", ["abc", "ab1"], [False, True]),
    ("", ["anything"], [True]),
])
def test_generic(value, pattern, lines, want):
    assert value(lambda c: D.detect_generic(c, pattern), lines) == want


def test_substring_modes(value):
    assert value(lambda c: D.detect_contains_ci(c, "World"), ["Hello WORLD", "foo"]) == [True, False]
    lines = ['{"level":"Error"}', '{"level":1}', '{"msg":"error"}', "not json", '{"level":{"a":"error"}}']
    assert value(lambda c: D.detect_json_substring(c, "level:error"), lines) == [True, False, False, False, False]
    assert value(lambda c: D.detect_json_substring(c, "failed"), ['{"message":"task FAILED"}', '{"x":"failed"}']) == [
        True, False]


def test_json_values_as_text(value):
    assert value(lambda c: D.detect_json(c, "n: ^1e\\+06$"), ['{"n":1000000}', '{"n":"1000000"}']) == [True, False]
    assert value(lambda c: D.detect_json(c, "n:<nil>"), ['{"n":null}', '{"m":null}']) == [True, False]


def test_registry():
    for fmt in D.KNOWN_FORMATS[:3]:
        assert D.detector_for(fmt, "ignored").name == fmt
    for bad in (("json", ""), ("custom", ""), ("", ""), ("xml", "x"), ("json", "nocolon")):
        with pytest.raises(ValueError):
            D.detector_for(*bad)


def test_own_detector(spark):
    own = D.Detector("oom", match=lambda c: c.contains("Out of memory"), message=lambda c: F.upper(c))
    df = spark.createDataFrame([("s", 1, "Out of memory: x"), ("s", 2, "ok")], "source string, line_no long, line string")
    row = D.matched_lines(df, own).collect()
    assert [(r.line, r.ts, r.ts_str, r.n_bytes) for r in row] == [("OUT OF MEMORY: X", 0.0, "", 16)]


def random_kernel_lines(seed, n=400):
    rng = random.Random(seed)
    rows, facts, t = [], [], 0.0
    for i in range(n):
        t += rng.choice([0, 0.5, 1, 4, 7])
        error, stamped = rng.random() < 0.15, rng.random() < 0.8
        header = rng.choice(["ata1", "ata1.00", "ata10", "usb", "", "dev "])
        stamp = rng.choice([t, t, max(0.0, t - 30), 0.0])
        text = "error text" if error else "plain text"
        middle = f"{header}: {text}" if header else text
        rows.append(("s", i * 3, f"[{stamp:10.3f}] {middle}" if stamped else f"  {text}"))
        facts.append((error, stamped, stamp if stamped else 0.0, header if stamped else ""))
    return rows, facts


@pytest.mark.parametrize("seed", [1, 2])
def test_context_equals_walk(spark, seed):
    rows, facts = random_kernel_lines(seed)
    df = spark.createDataFrame(rows, "source string, line_no long, line string")
    match = D.dmesg_detector().match
    want = [r[1] for r, keep in zip(rows, dmesg_keep(facts)) if keep]
    for spans in ((), (64,), (50, 4)):
        got = mark_context(df, match, spans).filter("detected").orderBy("line_no").collect()
        assert [r.line_no for r in got] == want
    # In two halves, the second one from the state the first one leaves.
    first, second = df.filter("line_no < 500"), df.filter("line_no >= 500")
    state = context_state(first, match)
    halves = mark_context(first, match).unionByName(mark_context(second, match, seed=state))
    assert [r.line_no for r in halves.filter("detected").orderBy("line_no").collect()] == want


def test_detect_all(spark):
    monitors = [
        {"name": "web", "format": "nginx", "exclude_pattern": "skip"}, {"name": "api", "format": "json", "pattern": "level:error"},
        {"name": "k", "type": "dmesg"}, {"name": "app", "pattern": "Boom"},
    ]
    rows = [("web", "web:/a", 0, "2024/01/27 10:00:01 [error] x"), ("web", "web:/a", 1, "2024/01/27 10:00:01 [error] skip"),
            ("api", "api", 0, '{"level":"error","ts":5}'), ("api", "api", 1, '{"level":"info"}'),
            ("k", "k", 0, "[1.5] a: fail"), ("k", "k", 1, " more"), ("app", "app", 0, "error"), ("app", "app", 1, "Boom")]
    df = spark.createDataFrame(rows, "monitor string, source string, line_no long, line string")
    got = {(r.monitor, r.line_no): (r.ts, r.line) for r in D.detect_all(df, monitors).collect()}
    assert set(got) == {("web", 0), ("api", 0), ("k", 0), ("k", 1), ("app", 1)}
    assert got["api", 0][0] == 5.0 and got["k", 0] == (1.5, "a: fail")
