"""Timing of the headline queries; prints one JSON line.

Each query is planned and run in full, its rows going to a sink that drops them.
Every query is run twice and the faster run counts, so that neither the start of
the JVM's compiler nor of the Python workers is measured. ``lines_per_second`` is
the rate of the timestamp functions, over all cores, on a few million lines made
from the driver's events, for comparison with the per-call figures of the baseline.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from emberline.catalog import load  # noqa: E402
from emberline.functions import timestamps as T  # noqa: E402
from emberline.plans.fixtures import line_of  # noqa: E402
from emberline.plans.storage import cut  # noqa: E402
from emberline.session import local_session  # noqa: E402

HEADLINE = (
    "detect_regex", "detect_literal", "detect_nginx", "detect_json_field", "detect_all",
    "ts_iso8601", "ts_syslog", "ts_cascade", "ts_json",
    "dmesg_context", "batch_anchored", "batch_default_window", "group_by_timestamp", "rate_limit",
    "inactivity_alerts", "build_events", "source_metrics", "attach_state_asof", "host_snapshots",
    "sanitize_documents", "tenant_routing", "whole_flow",
)
RATE_LINES = 4_000_000


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    begin = time.perf_counter()
    drain(make())
    return time.perf_counter() - begin


def rates(spark, sf: str, cores: int) -> dict:
    events = spark.read.parquet(f"{sf}/events.parquet")
    copies = max(1, -(-RATE_LINES // events.count()))
    many = events.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).repartition(cores * 2)
    lines = cut(many.select(*[line_of(f).alias(f) for f in ("iso", "nginx", "syslog", "access", "dmesg")]))
    n = lines.count()
    found = {}
    for name, column, tagged in (
        ("iso8601", "iso", T.tagged_iso), ("nginx_error", "nginx", T.tagged_nginx_error),
        ("nginx_access", "access", T.tagged_nginx_access), ("syslog", "syslog", T.tagged_syslog),
        ("dmesg", "dmesg", T.tagged_dmesg),
    ):
        make = lambda: T.with_parsed(lines.select(column), tagged(column), 1706745600.0)  # noqa: B023, E731
        timed(make)
        found[name] = round(n / timed(make))
    return found


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, partitions=cores, name="emberline-bench")
    catalog = load()
    spent = {}
    for name in HEADLINE:
        query = catalog.queries[name]
        runs = [timed(lambda: query(spark, sf)) for _ in range(2)]
        spent[name] = round(min(runs), 3)
    result = {
        "metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cores,
        "events": spark.read.parquet(f"{sf}/events.parquet").count(),
        "lines_per_second": rates(spark, sf, cores),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
