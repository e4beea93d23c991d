"""Detectors: which lines are issues, and how their parts are read.

A detector is a bundle of Column builders, so a new one needs no subclass::

    Detector("oom", match=lambda line: line.contains("Out of memory"),
             message=lambda line: F.trim(line))
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import kernel, timestamps
from emberline.functions.basics import as_col, bind
from emberline.functions.jsonlines import (
    field_text, field_type, go_value_string, json_context, json_object, split_key_pattern,
)
from emberline.functions.patterns import to_java
from emberline.functions.text import byte_length
from emberline.operators.context import mark_context

# Detector names, their patterns, and the characters that make a
# pattern more than a literal.
KNOWN_FORMATS = ("dmesg", "nginx", "nginx-error", "json")
NGINX_PATTERN = "(?i)(error|critical|crit|alert|emerg)"
DMESG_ERROR_PATTERN = "(?i)(error|fail|panic|oops|exception)"
REGEX_CHARACTERS = set(r"\.+*?()|[]{}^$")

Builder = Callable[[Column], Column]


@dataclass(frozen=True)
class Detector:
    """``match`` decides; the rest is optional.

    ``stamp`` gives a tagged timestamp text (see the timestamp functions), tried
    before the general cascade; ``message`` rewrites the line before grouping;
    ``context`` gives JSON text for the event; ``related`` also keeps the lines
    around a kernel error.
    """

    name: str
    match: Builder
    stamp: Builder | None = None
    message: Builder | None = None
    context: Builder | None = None
    related: bool = False


# --- predicates ------------------------------------------------------------

def is_literal(pattern: str) -> bool:
    return not REGEX_CHARACTERS & set(pattern)


def detect_generic(line, pattern: str) -> Column:
    """Unanchored regex search; a pattern without special characters is a substring test."""
    text = as_col(line)
    return F.contains(text, F.lit(pattern)) if is_literal(pattern) else text.rlike(to_java(pattern))


def detect_contains_ci(line, text: str) -> Column:
    return F.contains(F.lower(as_col(line)), F.lit(text.lower()))


def detect_json(line, pattern: str) -> Column:
    """``key:regex`` against the text of a top-level field of a JSON object line."""
    key, regex = split_key_pattern(pattern)
    return F.coalesce(
        bind(json_object(line), lambda o: detect_generic(go_value_string(o, key), regex)), F.lit(False)
    )


def detect_json_substring(line, pattern: str) -> Column:
    """``key:text`` case-insensitively inside a string field; without a colon the key is ``message``."""
    key, colon, text = pattern.partition(":")
    key, text = (key, text) if colon else ("message", pattern)
    return F.coalesce(
        bind(
            json_object(line),
            lambda o: (field_type(o, key) == "STRING") & detect_contains_ci(field_text(o, key), text),
        ),
        F.lit(False),
    )


# --- registry --------------------------------------------------------------

def generic_detector(pattern: str) -> Detector:
    return Detector("custom", lambda line: detect_generic(line, pattern))


def contains_detector(text: str) -> Detector:
    return Detector("contains", lambda line: detect_contains_ci(line, text))


def json_detector(pattern: str) -> Detector:
    split_key_pattern(pattern)
    return Detector(
        "json",
        lambda line: detect_json(line, pattern),
        stamp=timestamps.tagged_json,
        context=json_context,
    )


def json_substring_detector(pattern: str) -> Detector:
    return Detector("json-substring", lambda line: detect_json_substring(line, pattern))


def nginx_detector() -> Detector:
    return Detector("nginx", lambda line: detect_generic(line, NGINX_PATTERN), stamp=timestamps.tagged_nginx)


def nginx_error_detector() -> Detector:
    return Detector("nginx-error", lambda line: detect_generic(line, NGINX_PATTERN))


def dmesg_detector() -> Detector:
    return Detector(
        "dmesg",
        lambda line: detect_generic(line, DMESG_ERROR_PATTERN),
        stamp=timestamps.tagged_dmesg,
        message=kernel.strip_dmesg_timestamp,
        related=True,
    )


def detector_for(format: str, pattern: str = "") -> Detector:
    """The detector of a format name; raises ValueError for an unusable combination."""
    fixed = {"dmesg": dmesg_detector, "nginx": nginx_detector, "nginx-error": nginx_error_detector}
    if format in fixed:
        return fixed[format]()
    if format not in ("json", "custom", ""):
        raise ValueError(f"no detector of format {format!r}")
    if not pattern:
        raise ValueError(f"the {format or 'custom'} detector needs a pattern{' (key:regex)' if format == 'json' else ''}")
    return json_detector(pattern) if format == "json" else generic_detector(pattern)


def format_of(monitor: dict) -> str:
    """Detector format of one monitor: its own, else custom with a pattern, else by
    type, else by name, else custom."""
    if monitor.get("format"):
        return monitor["format"]
    if monitor.get("pattern"):
        return "custom"
    if monitor.get("type") == "dmesg":
        return "dmesg"
    return monitor.get("name") if monitor.get("name") in KNOWN_FORMATS else "custom"


# --- detection over a table of lines ---------------------------------------

def mark_detected(lines: DataFrame, detector: Detector, **plan) -> DataFrame:
    """Add ``detected``. Excluded lines must still be present here: they count as
    context for the lines after them."""
    if detector.related:
        return mark_context(lines, detector.match, **plan)
    return lines.withColumn("detected", F.coalesce(detector.match(F.col("line")), F.lit(False)))


def mark_excluded(lines: DataFrame, exclude: str | Builder | None) -> DataFrame:
    """Add ``excluded``: detected, but also matching the exclusion."""
    if not exclude:
        return lines.withColumn("excluded", F.lit(False))
    hit = detect_generic("line", exclude) if isinstance(exclude, str) else exclude(F.col("line"))
    return lines.withColumn("excluded", F.col("detected") & F.coalesce(hit, F.lit(False)))


def matched_lines(
    lines: DataFrame, detector: Detector, exclude: str | Builder | None = None, as_of=None, **plan
) -> DataFrame:
    """Issue lines with ``ts``, ``ts_str``, rewritten ``line`` and its ``n_bytes``.

    The cheap tests come first; timestamps are read only from lines that stay.
    """
    kept = mark_excluded(mark_detected(lines, detector, **plan), exclude)
    kept = kept.filter(F.col("detected") & ~F.col("excluded")).drop("detected", "excluded")
    stamped = timestamps.with_timestamps(kept, detector, as_of)
    if detector.message:
        stamped = stamped.withColumn("line", detector.message(F.col("line")))
    return stamped.withColumn("n_bytes", byte_length("line").cast("long"))


def monitor_rules(monitors: list[dict]) -> tuple[Callable[[str, bool | None], Builder | None], list[str]]:
    """``(choose, names of kernel-log monitors)``; ``choose(attribute, kernel_logs)`` builds one CASE over
    the column ``monitor`` from that part (``match``, ``stamp``, ``exclude``...) of the monitors' detectors,
    of kernel logs only, of the others only, or (None) of all.

    Monitors with the same rule share a branch with a literal pattern, so a regex is compiled
    once per task. A monitor goes by its ``id``, or else by its name.
    """
    rules: dict[tuple[str, str, str], list[str]] = {}
    for m in monitors:
        fmt = format_of(m)
        pattern = "" if fmt in ("dmesg", "nginx", "nginx-error") else m.get("pattern") or ""
        rules.setdefault((fmt, pattern, m.get("exclude_pattern") or ""), []).append(m.get("id", m["name"]))

    def choose(attribute: str, kernel_logs: bool | None) -> Builder | None:
        picks = []
        for (fmt, pattern, exclude), names in rules.items():
            detector = detector_for(fmt, pattern)
            if kernel_logs is not None and detector.related is not kernel_logs:
                continue
            if attribute == "exclude":
                part = (lambda line, e=exclude: detect_generic(line, e)) if exclude else None
            else:
                part = getattr(detector, attribute)
            if part:
                picks.append((names, part))
        if not picks:
            return None

        def build(line: Column) -> Column:
            chosen = None
            for names, part in picks:
                here = F.col("monitor").isin(names)
                chosen = F.when(here, part(line)) if chosen is None else chosen.when(here, part(line))
            return chosen

        return build

    return choose, [n for (fmt, _, _), names in rules.items() if fmt == "dmesg" for n in names]


def detect_all(lines: DataFrame, monitors: list[dict], as_of=None, **plan) -> DataFrame:
    """Issue lines of every monitor, each with its own detector and exclusion.

    ``lines`` carries a ``monitor`` column (see ``monitor_rules``). All stateless monitors
    share one pass; kernel logs need ordered state and form a second branch.
    """
    choose, kernel_names = monitor_rules(monitors)
    branches = []
    for kernel_logs in (False, True):
        names = [n for m in monitors if ((n := m.get("id", m["name"])) in kernel_names) is kernel_logs]
        if not names:
            continue
        detector = dmesg_detector() if kernel_logs else Detector(
            "monitors", choose("match", False), choose("stamp", False)
        )
        mine = lines.filter(F.col("monitor").isin(names))
        branches.append(matched_lines(mine, detector, choose("exclude", kernel_logs), as_of, **plan))
    result = branches[0]
    for other in branches[1:]:
        result = result.unionByName(other)
    return result
