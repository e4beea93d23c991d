"""A null source is a source: no plan may lose its rows."""

import pytest
from pyspark.sql import functions as F

from emberline.operators.batches import batches_by_count, group_batches
from emberline.operators.limits import rate_limit
from emberline.plans.ordered import running


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(None if i % 2 else "a", i, f"line {i}", float(i), str(i), 6) for i in range(12)]
    return spark.createDataFrame(rows, "source string, line_no long, line string, ts double, ts_str string, n_bytes long")


@pytest.mark.parametrize("spans", [(), (4,), (4, 4)])
def test_running(lines, spans):
    got = running(lines, ["source"], "line_no", {"seen": ("sum", "n_bytes")}, spans).collect()
    assert sorted((r.line_no, r.seen or 0) for r in got) == [(i, 6 * (i // 2)) for i in range(12)]


def test_batches(lines):
    for batches in (group_batches(lines), batches_by_count(lines, 2)):
        assert batches.agg(F.sum(F.size(F.split("message", "\n")))).first()[0] == 12


def test_rate_limit(lines):
    events = lines.select("source", F.col("line_no").alias("batch_id"), F.col("ts").alias("start_ts"))
    got = rate_limit(events, 2, 100.0).collect()
    assert len(got) == 12 and sum(r.passed for r in got) == 4
