import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from emberline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=8, partitions=4, name="emberline-tests")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a Column function over a list of inputs."""

    def run(fn, inputs, schema="x string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {schema}")
        out = df.coalesce(1).select("i", fn("x").alias("r")).orderBy("i").collect()
        return [row["r"].asDict() if hasattr(row["r"], "asDict") else row["r"] for row in out]

    return run
