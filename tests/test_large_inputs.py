"""A larger table has more parts, not longer tasks."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from emberline.catalog import common

TS = datetime.datetime(2024, 1, 5, 6, 7, 8)


def events(folder, n, **options):
    ids = range(n)
    pq.write_table(pa.table({
        "event_id": pa.array(ids, pa.int64()), "ts": pa.array([TS] * n, pa.timestamp("us")), "user_id": pa.array([4 * (i % 9) for i in ids], pa.int64()),
        "event_type": ["click"] * n, "value": [1.0] * n, "props": [f"{i * 7919 % 10007:0400d}" for i in ids]}), f"{folder}/events.parquet", **options)


def parts_of(df):
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    """As many scan parts as cores, but all rows in one of them."""
    events(tmp_path, 40_000, compression="none", use_dictionary=False)
    monkeypatch.setitem(common.PART_ROWS, "events", 2000)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        raw = spark.read.parquet(f"{tmp_path}/events.parquet")
        assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and parts_of(raw) == [40_000]
        dealt = common.table(spark, str(tmp_path), "events")
        parts = parts_of(dealt)
        assert sum(parts) == 40_000 and len(parts) == 20 and max(parts) < 2500
        assert dealt.agg(F.countDistinct("event_id")).first()[0] == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_even_scan_is_left_alone_and_no_rows_are_fine(spark, tmp_path):
    even = spark.range(0, 800, 1, 8)
    assert common.spread(even, 100) is even
    assert max(parts_of(common.spread(even, 99))) <= 99 + 9
    assert common.spread(spark.range(0), 10).count() == 0
