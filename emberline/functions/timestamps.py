"""Timestamp recognition for ISO 8601, nginx, kernel, syslog and JSON lines.

Each format has two halves: a *stamp* (the text of the timestamp inside the
line, NULL when the line has none) found by one regex that already contains the
value ranges, and its *seconds* (DOUBLE epoch seconds, or seconds since boot for
kernel lines), computed from the stamp alone. For the second half a dated stamp
is laid out with its zone so that Spark casts it natively; only what the cast
refuses (day 31 of a short month and second 60, which roll over; odd zones) goes
through integer arithmetic. The session time zone plays no part.

``parse_*`` join the halves into ``STRUCT<ts DOUBLE, ts_str STRING>`` (NULL when
not recognised). ``with_timestamps`` does the same over a table in projection
steps, so that each regex runs once per line and all of it stays in generated
code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.basics import as_col, bind, built_once, digits, fixed_point, found, int_div
from emberline.functions.jsonlines import field_text, field_type, json_object

# Month names, timestamp keys of JSON lines in order of
# preference, and the shapes of the timestamps.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
JSON_TIME_KEYS = ("time", "timestamp", "ts", "date", "@timestamp")

_MONTH = "(?:" + "|".join(MONTHS) + ")"
_DAY = r"(?:0[1-9]|[12]\d|3[01])"
_HOUR = r"(?:[01]\d|2[0-3])"
_MINUTE = r"[0-5]\d"
_SECOND = r"(?:[0-5]\d|60)"
_LEAP_YEAR = r"(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"


def _calendar_date(sep: str) -> str:
    """Year, month and day that exist."""
    return (
        rf"(?:\d{{4}}{sep}(?:(?:0[13578]|1[02]){sep}{_DAY}|(?:0[469]|11){sep}(?:0[1-9]|[12]\d|30)"
        rf"|02{sep}(?:0[1-9]|1\d|2[0-8]))|{_LEAP_YEAR}{sep}02{sep}29)"
    )


ISO_PATTERN = (
    rf"^\d{{4}}-(?:0[1-9]|1[0-2])-{_DAY}[T ]{_HOUR}:{_MINUTE}:{_SECOND}"
    r"(?:\.\d*)?(?:Z|[+-][0-9:]*)?"
)
NGINX_ERROR_PATTERN = rf"^{_calendar_date('/')} (?:{_HOUR}| \d):{_MINUTE}:[0-5]\d"
NGINX_ACCESS_PATTERN = (
    rf"\[({_DAY}/{_MONTH}/(?:19[7-9]\d|[2-9]\d{{3}}):{_HOUR}:{_MINUTE}:{_SECOND} [+-]\d\d{_MINUTE})\]"
)
DMESG_PATTERN = r"^\[(?=[^\]]{1,30}\]) *((?=[0-9.])[0-9]*\.?[0-9]*)\]"
SYSLOG_PATTERN = (
    rf"^(?:<[\s\S][^>]{{0,2}}>)?({_MONTH} (?: [1-9]|{_DAY}) {_HOUR}:{_MINUTE}:{_SECOND})"
)
BRACKET_PATTERN = r"^\[\s*([0-9.]+)\]"
# RFC 3339, and the two zone-less forms a JSON time field may have.
_JSON_CLOCK = rf"(?:\d|{_HOUR}):{_MINUTE}:[0-5]\d(?:[.,]\d+)?"
_JSON_ZONE = r"(?:Z|[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60))"
JSON_TIME_PATTERN = rf"^{_calendar_date('-')}(?:T{_JSON_CLOCK}{_JSON_ZONE}?| +{_JSON_CLOCK})$"
MAX_MILLIS_FREE = 1e11  # larger JSON numbers are milliseconds
YEAR_AHEAD_SECONDS = 30 * 24 * 3600  # a syslog date further ahead belongs to last year

_REST = 1 << 20


# --- calendar --------------------------------------------------------------

def epoch_days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01; days past the end of the month roll over."""
    y = year + 400 - F.when(month <= 2, 1).otherwise(0)
    shifted = (month + 9) % 12
    return (
        y * 365 + int_div(y, 4) - int_div(y, 100) + int_div(y, 400)
        + int_div(shifted * 153 + 2, 5) + day - (1 + 719468 + 146097)
    ).cast("long")


def _now(as_of) -> Column:
    if as_of is None:
        return F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    return as_of if isinstance(as_of, Column) else F.lit(float(as_of))


def _date_of(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


# --- stamps ----------------------------------------------------------------

def iso_stamp(line) -> Column:
    return found(as_col(line), ISO_PATTERN)


def nginx_error_stamp(line) -> Column:
    return found(as_col(line), NGINX_ERROR_PATTERN)


def nginx_access_stamp(line) -> Column:
    """First *valid* bracketed time; the regex holds the ranges, so a bad one is passed over."""
    return found(as_col(line), NGINX_ACCESS_PATTERN, 1)


def dmesg_stamp(line) -> Column:
    return found(as_col(line), DMESG_PATTERN, 1)


def syslog_stamp(line) -> Column:
    return found(as_col(line), SYSLOG_PATTERN, 1)


# A tagged stamp is the stamp with one leading letter that names its format:
# i ISO, n nginx error, a nginx access, d kernel, s syslog, j JSON text, f JSON number.

def tagged_iso(line) -> Column:
    return F.concat(F.lit("i"), iso_stamp(line))


def tagged_nginx_error(line) -> Column:
    return F.concat(F.lit("n"), nginx_error_stamp(line))


def tagged_nginx_access(line) -> Column:
    return F.concat(F.lit("a"), nginx_access_stamp(line))


def tagged_syslog(line) -> Column:
    return F.concat(F.lit("s"), syslog_stamp(line))


def tagged_cascade(line) -> Column:
    """Stamp of whichever format the first character allows."""
    text = as_col(line)
    first = F.substring(text, 1, 1)
    digit = first.between("0", "9")
    return F.coalesce(
        F.when(first == "[", tagged_dmesg(text)),
        F.when(digit, tagged_iso(text)),
        F.when(digit, tagged_nginx_error(text)),
        F.when((first == "<") | first.between("A", "Z"), tagged_syslog(text)),
        F.when(F.contains(text, F.lit("[")), tagged_nginx_access(text)),
    )


_cascade_of = built_once(tagged_cascade)


def tagged_nginx(line) -> Column:
    return F.coalesce(tagged_nginx_error(line), tagged_nginx_access(line))


def tagged_dmesg(line) -> Column:
    return F.concat(F.lit("d"), dmesg_stamp(line))


def _tagged_json_field(obj: Column, key: str) -> Column:
    def tag(text: Column) -> Column:
        # Only a JSON string can look like a date; a number must not be a string.
        number = text.rlike(r"^-?[0-9]") & (field_type(obj, key) != "STRING")
        return F.when(text.rlike(JSON_TIME_PATTERN), F.concat(F.lit("j"), text)).when(
            number, F.concat(F.lit("f"), text)
        )

    return bind(field_text(obj, key), tag)


def tagged_json_object(obj: Column) -> Column:
    """First of the time keys whose value is a time, from a parsed object."""
    return F.coalesce(*[_tagged_json_field(obj, key) for key in JSON_TIME_KEYS])


def tagged_json(line) -> Column:
    return bind(json_object(line), tagged_json_object)


# --- seconds ---------------------------------------------------------------

def _month_digits(name: Column) -> Column:
    table = "".join(f"{n:03d}" for n in range(1, 13))
    return F.substring(F.lit(table), F.instr(F.lit("".join(MONTHS)), name) + 1, F.lit(2))


def _dated_text(kind: Column, stamp: Column, as_of) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of the stamps that have another order of fields."""
    return (
        F.when(kind == "n", F.translate(stamp, "/", "-"))
        .when(kind == "a", F.concat(
            F.substring(stamp, 8, 4), F.lit("-"), _month_digits(F.substring(stamp, 4, 3)), F.lit("-"),
            F.substring(stamp, 1, 2), F.lit(" "), F.substring(stamp, 13, 8),
        ))
        .when(kind == "s", F.concat(
            F.lpad(F.year(_date_of(_now(as_of))).cast("string"), 4, "0"), F.lit("-"),
            _month_digits(F.substring(stamp, 1, 3)), F.lit("-"), F.translate(F.substring(stamp, 5, 2), " ", "0"),
            F.lit(" "), F.substring(stamp, 8, 8),
        ))
    )


def _castable(kind: Column, stamp: Column, as_of=None) -> Column:
    """Text that a plain cast to timestamp reads as the right instant; NULL where the
    general way is needed (odd fractions and zones) or the stamp holds no date."""
    whole_zone = r"^.{19}(?:\.\d{1,6})?(?:Z|[+-]\d\d(?::?\d\d)?)$"
    iso = (
        F.when(F.length(stamp) == 19, F.concat(stamp, F.lit("Z")))
        .when(stamp.rlike(whole_zone), stamp)
        .when(stamp.rlike(r"^.{19}\.\d{1,6}$"), F.concat(stamp, F.lit("Z")))
    )
    zone = F.when(kind == "a", F.substring(stamp, 22, 5)).otherwise("Z")
    return F.when(kind.isin("i", "j"), iso).otherwise(F.concat(_dated_text(kind, stamp, as_of), zone))


def _micros(castable: Column) -> Column:
    return F.unix_micros(castable.try_cast("timestamp"))


def _general_seconds(kind: Column, stamp: Column, as_of=None) -> Column:
    """Seconds of any dated stamp by integer arithmetic: days past the end of a month
    and second 60 roll over, zones may be malformed (then UTC), fractions have nine
    digits. Rarely needed, so it is kept out of the generated code (by ``bind``)."""

    def of_text(text: Column) -> Column:
        days = epoch_days(digits(text, 1, 4), digits(text, 6, 2), digits(text, 9, 2))
        return days * 86400 + digits(text, 12, 2) * 3600 + digits(text, 15, 2) * 60 + digits(text, 18, 2)

    def of_parts(p: Column) -> Column:
        kind, stamp = p["kind"], p["stamp"]
        clock = F.lpad(F.regexp_extract(stamp, r"[T ](\d{1,2}):", 1), 2, "0")
        iso = F.concat(F.substring(stamp, 1, 10), F.lit(" "), clock, F.regexp_extract(stamp, r":\d\d:\d\d", 0))
        whole = bind(F.when(kind.isin("i", "j"), iso).otherwise(_dated_text(kind, stamp, as_of)), of_text)
        tail = F.when(kind == "a", F.substring(stamp, 22, 5)).when(
            kind.isin("i", "j"), F.regexp_extract(stamp, r":\d\d:\d\d(.*)$", 1)
        ).otherwise("")
        return bind(
            F.struct(whole.alias("whole"), tail.alias("tail")),
            lambda q: (q["whole"] - _zone_seconds(q["tail"])).cast("double") + _fraction(q["tail"]),
        )

    return bind(F.struct(kind.alias("kind"), stamp.alias("stamp")), of_parts)


def _fraction(tail: Column) -> Column:
    frac = F.regexp_extract(tail, r"^[.,](\d{1,9})", 1)
    return F.rpad(frac, 9, "0").cast("long").cast("double") / F.lit(1e9)


def _zone_seconds(tail: Column) -> Column:
    """Offset of a trailing ``+HH``, ``+HHMM`` or ``+HH:MM``; anything else is UTC."""
    sign = F.when(F.contains(tail, F.lit("-")), -1).otherwise(1)
    zone = F.translate(F.regexp_extract(tail, r"[+-](\d\d(?::?\d\d)?)$", 1), ":", "")
    offset = sign * (digits(zone, 1, 2) * 3600 + F.coalesce(digits(zone, 3, 2), F.lit(0)) * 60)
    return F.coalesce(offset, F.lit(0))


def _in_past(seconds: Column, as_of) -> Column:
    """A syslog time, moved to the year before when it lies too far ahead."""

    def last_year(s: Column) -> Column:
        date = _date_of(s)
        return epoch_days(F.year(date) - 1, F.month(date), F.day(date)) * 86400 + F.pmod(s, F.lit(86400.0))

    return F.when(seconds - _now(as_of) > YEAR_AHEAD_SECONDS, bind(seconds, last_year)).otherwise(seconds)


def dmesg_seconds(stamp: Column) -> Column:
    whole = F.substring_index(stamp, ".", 1)
    frac = F.substring(stamp, F.length(whole) + 2, F.lit(64))
    number = lambda t: F.coalesce(t.try_cast("double"), F.lit(0.0))
    return number(whole) + number(frac) / F.pow(F.lit(10.0), F.length(frac))


def _dated_seconds(kind: Column, stamp: Column, micros: Column, as_of=None) -> Column:
    part = F.pmod(micros, F.lit(1000000))
    quick = (micros - part) / F.lit(1e6) + part * 1000 / F.lit(1e9)
    return F.coalesce(quick, _general_seconds(kind, stamp, as_of))


def _seconds(kind: Column, stamp: Column, dated: Column, as_of=None) -> Column:
    number = stamp.try_cast("double")
    return (
        F.when(kind == "d", dmesg_seconds(stamp))
        .when(kind == "f", F.when(number > MAX_MILLIS_FREE, number / 1000.0).otherwise(number))
        .when(kind == "s", _in_past(dated, as_of))
        .otherwise(dated)
    )


def _shown(kind: Column, stamp: Column, seconds: Column) -> Column:
    return F.when(kind == "f", fixed_point(seconds, 3)).otherwise(stamp)


def _parsed(tagged: Column, as_of=None) -> Column:
    """``STRUCT<ts, ts_str>`` of a tagged stamp, NULL when there is none."""

    def from_tag(tag: Column) -> Column:
        kind, stamp = F.substring(tag, 1, 1), F.substring(tag, 2, _REST)
        dated = bind(_micros(_castable(kind, stamp, as_of)), lambda m: _dated_seconds(kind, stamp, m, as_of))
        return bind(
            bind(dated, lambda d: _seconds(kind, stamp, d, as_of)),
            lambda ts: F.when(ts.isNotNull(), F.struct(ts.alias("ts"), _shown(kind, stamp, ts).alias("ts_str"))),
        )

    return bind(tagged, from_tag)


def parse_iso8601(line) -> Column:
    return _parsed(tagged_iso(line))


def parse_nginx_error(line) -> Column:
    return _parsed(tagged_nginx_error(line))


def parse_nginx_access(line) -> Column:
    return _parsed(tagged_nginx_access(line))


def parse_dmesg_ts(line) -> Column:
    return _parsed(tagged_dmesg(line))


def parse_syslog_ts(line, as_of=None) -> Column:
    """``as_of`` (epoch seconds) decides the year: its own, or the one before when the
    date would lie more than 30 days ahead."""
    return _parsed(tagged_syslog(line), as_of)


def json_timestamp(line) -> Column:
    return _parsed(tagged_json(line))


def extract_timestamp(line, as_of=None) -> Column:
    """Try the formats the first character allows; ``(0.0, '')`` when none fits."""
    none = F.struct(F.lit(0.0).alias("ts"), F.lit("").alias("ts_str"))
    return F.coalesce(_parsed(tagged_cascade(line), as_of), none)


# --- other spellings -------------------------------------------------------

def extract_timestamp_key(line) -> Column:
    """Grouping key: first non-empty bracket content, else a 15-character syslog
    date, else an ISO prefix up to the first blank or ``Z``, else ``unknown``."""
    text = as_col(line)
    after = F.regexp_extract(text, r"(?s)\[(.*)$", 1)
    bracket = F.when(
        F.contains(after, F.lit("]")), F.nullif(F.substring_index(after, "]", 1), F.lit(""))
    )
    at = lambda pos: F.substring(text, pos, 1)
    syslog = F.when(
        (F.length(text) >= 15) & (at(4) == " ") & (at(7) == " ") & (at(10) == ":") & (at(13) == ":"),
        F.substring(text, 1, 15),
    )
    prefix = F.when(text.rlike("[ Z]"), F.regexp_extract(text, r"(?s)^([^ Z]*)", 1)).otherwise(
        F.substring(text, 1, 19)
    )
    iso = F.when((F.length(text) >= 19) & (at(5) == "-") & (at(8) == "-"), prefix)
    return F.coalesce(bracket, syslog, iso, F.lit("unknown"))


def bracket_timestamp(message) -> Column:
    """Leading bracketed number of a whole message, as text; NULL when there is none."""
    return found(as_col(message), BRACKET_PATTERN, 1)


# --- the staged operators --------------------------------------------------

@built_once
def _steps(as_of) -> tuple[Column, Column, Column, Column]:
    kind, stamp, dated = F.col("_kind"), F.col("_stamp"), F.col("_dated")
    return (
        _micros(_castable(kind, stamp, as_of)),
        F.when(~kind.isin("d", "f"), _dated_seconds(kind, stamp, F.col("_micros"), as_of)),
        _seconds(kind, stamp, dated, as_of),
        _shown(kind, stamp, F.col("ts")),
    )


def with_parsed(df: DataFrame, tagged: Column, as_of: float | None = None) -> DataFrame:
    """Add ``ts`` and ``ts_str`` of a tagged stamp, NULL where there is none.

    The same as the ``parse_*`` columns in projection steps: each step is read
    several times by the next, so Spark evaluates it once, in generated code.
    """
    micros, dated, ts, ts_str = _steps(as_of)
    return (
        df.withColumn("_tag", tagged)
        .withColumns({"_kind": F.substring("_tag", 1, 1), "_stamp": F.substring("_tag", 2, _REST)})
        .withColumn("_micros", micros).withColumn("_dated", dated).withColumn("ts", ts).withColumn("ts_str", ts_str)
        .drop("_tag", "_kind", "_stamp", "_micros", "_dated")
    )


def with_timestamps(df: DataFrame, detector=None, as_of=None, line: str = "line") -> DataFrame:
    """Add ``ts`` and ``ts_str``: the detector's own format first, then the cascade,
    else ``0.0`` and ``''``."""
    own = getattr(detector, "stamp", None)
    cascade = _cascade_of(line)
    parsed = with_parsed(df, F.coalesce(own(F.col(line)), cascade) if own else cascade, as_of)
    return parsed.fillna({"ts": 0.0, "ts_str": ""})
