"""Cutting lineage in the shared folder the session names."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER_SETTING = "spark.checkpoint.dir"
_KEPT: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors and the driver share.

    That is ``spark.checkpoint.dir``. A session on one machine that names none uses
    a folder inside its own warehouse; on a cluster a missing setting is an error,
    raised before anything runs.
    """
    folder = spark.conf.get(FOLDER_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"start the session with {FOLDER_SETTING} set to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, for data that must outlive a task."""
    return f"{shared_folder(spark)}/emberline-{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_kept() -> None:
    for spark, path in _KEPT:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone, and with it the way to the store
            return


atexit.register(_remove_kept)


def cut(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write a table that several later passes read, and read it back (in ``spark``).

    Parquet rather than an RDD checkpoint, so that each pass reads only its own
    columns. Survives the loss of executors. The table is deleted when the program
    ends; ``tables`` deletes those of a block of work as soon as it is over.
    """
    spark = spark or df.sparkSession
    path = new_path(spark, "table")
    df.write.parquet(path)
    _KEPT.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Intermediate tables of one block of work."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "table")
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(stored)] = (stored, path)
        return stored

    def drop(self, stored: DataFrame) -> None:
        """Delete one table that nothing reads any more."""
        _, path = self._paths.pop(id(stored))
        remove(self.spark, path)

    def drop_all(self) -> None:
        for stored, _ in list(self._paths.values()):
            self.drop(stored)


@contextmanager
def tables(spark: SparkSession):
    """``with tables(spark) as t``: what ``t.cut`` wrote is deleted at the end, so the
    result that leaves the block must be written by ``cut`` or not read from them."""
    held = Tables(spark)
    try:
        yield held
    finally:
        held.drop_all()


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the biggest group; one small aggregation and one number to the driver.

    Meant for stored tables: plans take the short way where groups are known to be
    small enough for one task, and the long way otherwise.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
