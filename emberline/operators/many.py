"""Many patterns against each line.

What a match must contain is taken from every pattern and put into one automaton, so a line is
scanned once however many monitors there are; only patterns whose literal was found are then
run by the JVM. A pattern without such a literal is run on every line.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions import patterns
from emberline.operators.detect import KNOWN_FORMATS, NGINX_PATTERN, detect_all, format_of, is_literal

CANDIDATES = "_candidates"


def literals_of(monitor: dict) -> frozenset[str] | None:
    """Lower-cased texts of which each line that the monitor takes holds one; None if that is unknown."""
    fmt, pattern = format_of(monitor), monitor.get("pattern") or ""
    if fmt in ("nginx", "nginx-error"):
        return patterns.required(NGINX_PATTERN)
    if fmt in KNOWN_FORMATS:
        return None  # JSON may spell a field in several ways
    return frozenset([pattern.lower()]) if pattern and is_literal(pattern) else patterns.required(pattern)


def with_candidates(lines: DataFrame, monitors: list[dict]) -> DataFrame:
    """Add the names of the monitors whose literals are in the line, and of those without literals."""
    needs = {m["name"]: literals_of(m) for m in monitors}
    always = [name for name, texts in needs.items() if texts is None]
    owners: dict[str, list[str]] = {}
    for name, texts in needs.items():
        for text in texts or ():
            owners.setdefault(text, []).append(name)
    at = lines.columns.index("line")

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, names in owners.items():
            automaton.add_word(text, names)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for line in batch.column(at).to_pylist():
                names = set(always) if line is not None else set()
                if line and owners:
                    for _, texts in automaton.iter(line.lower()):
                        names.update(texts)
                found.append(sorted(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, CANDIDATES])

    schema = T.StructType([*lines.schema.fields, T.StructField(CANDIDATES, T.ArrayType(T.StringType()))])
    return lines.mapInArrow(run, schema)


def detect_many(lines: DataFrame, monitors: list[dict], as_of=None) -> DataFrame:
    """Issue lines ``(source, line_no, line)`` of every monitor, when all monitors read all lines: the result of
    ``detect_all`` over each line once per monitor. Names must differ. Kernel-log monitors, whose
    detection depends on the lines around, are refused.
    """
    if len({m["name"] for m in monitors}) < len(monitors):
        raise ValueError("two monitors of one name")
    kernel = [m["name"] for m in monitors if format_of(m) == "dmesg"]
    if kernel:
        raise ValueError(f"kernel-log monitors need all their lines: {kernel}")
    candidates = with_candidates(lines.drop("monitor", CANDIDATES), monitors)
    return detect_all(candidates.withColumn("monitor", F.explode(CANDIDATES)).drop(CANDIDATES), monitors, as_of)
