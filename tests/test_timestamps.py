"""Case tables for the timestamp functions."""

import random
import re
from datetime import datetime, timezone

import pytest

from emberline.functions import timestamps as T


def epoch(*parts):
    return datetime(*parts, tzinfo=timezone.utc).timestamp()


AS_OF = epoch(2024, 2, 1)
RNG = random.Random(11)


def instants(n):
    """Moments from 1971 to 2037, to the second."""
    return [datetime.fromtimestamp(RNG.randrange(31_536_000, 2_114_380_800), timezone.utc) for _ in range(n)]


def iso_cases():
    """Each moment with and without fraction, in every spelling of an offset."""
    for when in instants(6):
        for joint in "T ":
            for fraction in ("", f".{RNG.randrange(1, 1000):03d}", f".{RNG.randrange(1, 10)}"):
                for hours, minutes, form in ((0, 0, ""), (0, 0, "Z"), (3, 45, "+{:02d}:{:02d}"), (11, 30, "-{:02d}{:02d}"), (9, 0, "+{:02d}")):
                    stamp = when.strftime(f"%Y-%m-%d{joint}%H:%M:%S") + fraction + form.format(hours, minutes)
                    east = -1 if form.startswith("-") else 1
                    yield f"{stamp} disk {RNG.randrange(99)} full", when.timestamp() + float("0" + fraction if fraction else 0) - east * (hours * 3600 + minutes * 60), stamp


def spelt(pattern, line="{} tail", odd=""):
    """Moments in one format, as (line, seconds, stamp)."""
    for when in instants(8):
        stamp = when.strftime(pattern) + odd
        yield line.format(stamp), when.timestamp(), stamp


def broken(cases, *changes):
    """Lines of the cases after a change that makes their stamp unreadable."""
    return [(re.sub(old, new, line, count=1), None, None) for line, _, _ in cases for old, new in changes]


ISO = list(iso_cases())
ISO += broken(ISO[:4], (r"^(....)-", r"\1/"), (r":(..)", r"-\1"), (r"-..", "-17"), (r"([T ])..:", r"\g<1>31:"), (r"[T ].*", ""), (".*", ""))
ISO += [
    ("2031-04-31T05:06:07Z the day after the thirtieth", epoch(2031, 5, 1, 5, 6, 7), "2031-04-31T05:06:07Z"),
    ("2019-06-30T23:59:60Z one second more", epoch(2019, 7, 1), "2019-06-30T23:59:60Z"),
    ("2026-08-09T01:02:03+7:5 an offset of another kind", epoch(2026, 8, 9, 1, 2, 3), "2026-08-09T01:02:03+7:5"),
    ("2026-08-09T01:02:03. nothing after the point", epoch(2026, 8, 9, 1, 2, 3), "2026-08-09T01:02:03."),
]
ERROR_LOG = list(spelt("%Y/%m/%d %H:%M:%S", "{} [warn] worker"))
ERROR_LOG += broken(ERROR_LOG[:3], ("/", "-"), (r":..(?= \[)", ":61"))
ERROR_LOG += [("2032/02/29 08:09:10 in a leap year", epoch(2032, 2, 29, 8, 9, 10), "2032/02/29 08:09:10"), ("2031/02/29 08:09:10 in none", None, None)]
ACCESS = list(spelt("%d/%b/%Y:%H:%M:%S", "192.0.2.7 - eve [{}] \"PUT\"", " +0000"))
ACCESS += [
    ("[09/Sep/2021:21:30:00 -0330] west of here", epoch(2021, 9, 10, 1), "09/Sep/2021:21:30:00 -0330"),
    ("[note] [04/Abc/2021:01:02:03 +0000] [05/May/2022:02:00:00 +0200] the third will do", epoch(2022, 5, 5), "05/May/2022:02:00:00 +0200"),
    ("[31/Apr/2021:04:05:06 +0000]", epoch(2021, 5, 1, 4, 5, 6), "31/Apr/2021:04:05:06 +0000"),
    ("[09/Sep/1968:01:02:03 +0000]", None, None), ("[09/Sep]", None, None), ("", None, None),
]
ACCESS += broken(ACCESS[:3], ("/[A-Z]..", "/Qux"), (r"(/\d{4}):", r"\1 "), ("]", ""))
KERNEL = [(f"[{' ' * RNG.randrange(5)}{n}.{f:06d}] eth{f % 3}: up", n + f / 1e6, f"{n}.{f:06d}") for n, f in ((RNG.randrange(10**6), RNG.randrange(10**6)) for _ in range(9))]
KERNEL += [
    ("[86]", 86.0, "86"), ("[.] only a point", 0.0, "."), ("[7.] no fraction", 7.0, "7."), ("[4.5.6] two points", None, None),
    ("[soon] x", None, None), ("[2 ] x", None, None), ("[] x", None, None), (" [2.5] x", None, None),
    ("[" + " " * 29 + "8] as long as allowed", 8.0, "8"), ("[" + " " * 30 + "8] longer", None, None),
]


def system_cases():
    """The year is that of AS_OF, or the one before if that would be over 30 days ahead."""
    for when in instants(12):
        day = when.day if not (when.month == 2 and when.day == 29) else 28
        stamp = f"{when.strftime('%b')} {day:2d} {when.strftime('%H:%M:%S')}"
        this = epoch(2024, when.month, day, when.hour, when.minute, when.second)
        ahead = this - AS_OF > 30 * 86400
        yield f"{RNG.choice(['', '<7>', '<191>'])}{stamp} gate", epoch(2023, when.month, day, when.hour, when.minute, when.second) if ahead else this, stamp


SYSTEM = list(system_cases())
SYSTEM += broken(SYSTEM[:3], ("[A-Z][a-z]{2}", "Zzz"), (r"( )[ \d]\d ", r"\g<1>47 "), (r" \d\d:", " 77:"), (" [^ ]*:.*", ""), ("^(<.*>)?", "<9999>"))
SYSTEM += [(line.lower(), None, None) for line, _, _ in SYSTEM[:2]]
SYSTEM += [("Mar  2 00:00:00 just thirty days on", epoch(2024, 3, 2), "Mar  2 00:00:00"), ("Mar  2 00:00:01 a second more", epoch(2023, 3, 2, 0, 0, 1), "Mar  2 00:00:01")]


@pytest.mark.parametrize("fn,cases", [
    (T.parse_iso8601, ISO), (T.parse_nginx_error, ERROR_LOG), (T.parse_nginx_access, ACCESS), (T.parse_dmesg_ts, KERNEL),
    (lambda c: T.parse_syslog_ts(c, AS_OF), SYSTEM),
])
def test_parsers(value, fn, cases):
    got = value(fn, [c[0] for c in cases])
    for (line, ts, stamp), out in zip(cases, got):
        if ts is None:
            assert out is None, line
        else:
            assert out["ts_str"] == stamp and out["ts"] == pytest.approx(ts, abs=1e-6), line


def test_syslog_leap_day_goes_to_march_first(value):
    as_of = epoch(2024, 1, 1)
    out = value(lambda c: T.parse_syslog_ts(c, as_of), ["Feb 29 00:00:00 x"])[0]
    assert out["ts"] == epoch(2023, 3, 1)


def test_cascade(value):
    """Every format is found behind its own kind of beginning, and nothing in a line without a stamp."""
    cases = [(line, stamp) for table in (ISO[:5], ERROR_LOG[:3], ACCESS[:3], KERNEL[:3], SYSTEM[:3]) for line, _, stamp in table]
    cases += [(f"{address} - - [{stamp}] GET", stamp) for address, (_, _, stamp) in zip(["2001:db8::5", "[2001:db8::6]", "203.0.113.9"], ACCESS)]
    cases += [("nothing to see at all", ""), ("", ""), ("no. 7 of 9", "")]
    got = value(lambda c: T.extract_timestamp(c, AS_OF), [c[0] for c in cases])
    assert [g["ts_str"] for g in got] == [c[1] for c in cases]
    assert all((g["ts"] > 0) == bool(g["ts_str"]) for g in got)


def test_staged_equals_column(spark):
    lines = [c[0] for c in ISO] + [table[0][0] for table in (ERROR_LOG, ACCESS, KERNEL, SYSTEM)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    staged = T.with_timestamps(df, as_of=AS_OF)
    rows = staged.withColumn("c", T.extract_timestamp("line", AS_OF)).collect()
    assert all((r.ts, r.ts_str) == (r.c.ts, r.c.ts_str) for r in rows)


def test_json_timestamp(value):
    at, text = epoch(2027, 3, 4, 5, 6, 7), "2027-03-04T05:06:07"
    cases = [
        (f'{{"time":"{text}Z"}}', at, f"{text}Z"), (f'{{"time":"{text}.25-01:00"}}', at + 3600.25, f"{text}.25-01:00"),
        (f'{{"date":"{text.replace("T", " ")}"}}', at, text.replace("T", " ")), (f'{{"date":"{text}"}}', at, text),
        (f'{{"ts":{at:.0f}}}', at, f"{at:.3f}"), (f'{{"timestamp":{at:.0f}000}}', at, f"{at:.3f}"),
        (f'{{"time":"later","@timestamp":"{text}Z"}}', at, f"{text}Z"), ('{"time":"2027-04-31T05:06:07Z"}', None, None),
        ('{"note":"none"}', None, None), ('{"time":"later"}', None, None), ('{"time":false}', None, None), ('{"ts":5} and more', None, None),
    ]
    got = value(T.json_timestamp, [c[0] for c in cases])
    for (line, ts, stamp), out in zip(cases, got):
        assert (out and (out["ts"], out["ts_str"])) == (ts and (ts, stamp)), line


def test_grouping_key(value):
    cases = [
        ("[77.125] first bracket", "77.125"), ("job [nightly] began", "nightly"), ("Jun  3 04:05:06 gate cron: ran", "Jun  3 04:05:06"),
        ("2027-03-04T05:06:07Z gate", "2027-03-04T05:06:07"), ("2027-03-04 05:06:07 gate", "2027-03-04"),
        ("2027-03-04T05:06:07-01:00", "2027-03-04T05:06:07"), ("[] 2027-03-04", "unknown"), ("nothing here", "unknown"),
    ]
    assert value(T.extract_timestamp_key, [c[0] for c in cases]) == [c[1] for c in cases]


def test_bracket_timestamp(value):
    assert value(T.bracket_timestamp, ["[ 1.5] x\ny", "x [1.5]", "[a] x"]) == ["1.5", None, None]
