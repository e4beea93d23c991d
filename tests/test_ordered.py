"""Ordered plans against plain walks."""

import random
from functools import partial

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.plans import chains, kernels
from emberline.plans.ordered import running, with_ordinals
from tests.folds import batch_anchors, limiter


def in_blocks(pdf, block, size, overlap, fan):
    """Drive the kernels as the plan does, without Spark."""
    keys, n = ["source"], len(pdf)
    parts = []
    for b in range((n + size - 1) // size):
        piece = pdf.iloc[b * size: (b + 1) * size + overlap].copy()
        piece["own"] = (piece["ordinal"] < (b + 1) * size).astype(int)
        piece["block"] = b
        parts.append(piece)
    steps = pd.concat([kernels.steps_of_block(block, keys)(p) for p in parts])
    steps["super"] = steps["block"] // fan
    supers = pd.concat([kernels.steps_of_group(keys, "block", "super")(g) for _, g in steps.groupby("super")])
    top = kernels.walk_from_start(keys, "super")(supers)
    states = pd.concat([
        kernels.walk_from_state(keys, "block")(g, top[top["super"] == s]) for s, g in steps.groupby("super")
    ])
    out = pd.concat([
        kernels.anchors_of_block(block, keys, "line_no")(p, states[states["block"] == p["block"].iloc[0]])
        for p in parts
    ])
    return out.sort_values("ordinal")["anchor"].tolist()


def frame(n, **columns):
    return pd.DataFrame({"source": "s", "line_no": range(n), "ordinal": range(n), **columns})


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_capped_kernel_equals_walk(data):
    n = data.draw(st.integers(1, 60))
    stamps = data.draw(st.lists(st.sampled_from([0.0, 0.0, 1.0, 2.5, 5.0, 6.0, 7.5, 11.0, 12.0, 30.0]), min_size=n, max_size=n))
    if data.draw(st.booleans()):
        stamps = sorted(stamps)
    sizes = data.draw(st.lists(st.integers(0, 9), min_size=n, max_size=n))
    cap, limit = data.draw(st.integers(1, 6)), data.draw(st.integers(1, 40))
    size, fan = data.draw(st.integers(cap, 12)), data.draw(st.integers(1, 3))
    pdf = frame(n, ts=np.array(stamps), n_bytes=np.array(sizes, dtype=np.int64))
    block = partial(kernels.capped_block, window=5.0, max_lines=cap, max_bytes=limit)
    assert in_blocks(pdf, block, size, cap, fan) == batch_anchors(list(zip(stamps, sizes)), 5.0, cap, limit)


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_clock_kernel_equals_walk(data):
    n = data.draw(st.integers(1, 60))
    clock = sorted(data.draw(st.lists(st.integers(0, data.draw(st.integers(1, 80))), min_size=n, max_size=n)))
    window, burst = data.draw(st.integers(0, 12)), data.draw(st.integers(1, 4))
    pdf = frame(n, clock=np.array(clock, dtype=np.int64), window=np.int64(window))
    anchors = in_blocks(pdf, kernels.clock_block, data.draw(st.integers(1, 9)), 0, data.draw(st.integers(1, 3)))
    assert [i - a < burst for i, a in enumerate(anchors)] == limiter(clock, burst, window)


def sample(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "a", "b"])
        rows.append((source, i * rng.choice([1, 3]) + i * 7, rng.choice([None, rng.randint(0, 50)])))
    return list({(s, o): (s, o, v) for s, o, v in rows}.values())


def test_running_equals_plain_window(spark):
    df = spark.createDataFrame(sample(1), "source string, o long, v long").withColumn("one", F.lit(1))
    wanted = {"prev": ("last", "v"), "top": ("max", "v"), "n": ("sum", "one")}
    chunked = running(df, ["source"], "o", wanted, spans=(40, 10))
    w = Window.partitionBy("source").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("prev", F.last("v", ignorenulls=True).over(w)).withColumn("top", F.max("v").over(w)) \
        .withColumn("n", F.coalesce(F.sum("one").over(w), F.lit(0)))
    order = ["source", "o"]
    assert [tuple(r) for r in chunked.orderBy(order).select(*plain.columns).collect()] == [
        tuple(r) for r in plain.orderBy(order).collect()]


def test_ordinals(spark):
    df = spark.createDataFrame(sample(2), "source string, o long, v long")
    rows = with_ordinals(df, ["source"], "o", spans=(64, 4)).orderBy("source", "o").collect()
    for source in {r.source for r in rows}:
        mine = [r.ordinal for r in rows if r.source == source]
        assert mine == list(range(len(mine)))


def test_anchored_on_spark_equals_walk(spark):
    rng = random.Random(7)
    rows, clock = [], 1000.0
    for i in range(2000):
        clock += rng.choice([0, 0, 0.5, 1, 2, 9])
        rows.append((rng.choice(["hot", "hot", "x"]), i, rng.choice([clock, clock, 0.0, clock - 20]), rng.randint(0, 30)))
    df = spark.createDataFrame(rows, "source string, line_no long, ts double, n_bytes long")
    numbered = with_ordinals(df, ["source"], "line_no", spans=(128, 4))
    got = chains.anchored(numbered, ["source"], "line_no", chains.capped_block(5.0, 7, 100), overlap=7,
                          block_rows=32, fan=4).collect()
    for source in ("hot", "x"):
        mine = [(r[2], r[3]) for r in rows if r[0] == source]
        out = [r.anchor for r in sorted((r for r in got if r.source == source), key=lambda r: r.ordinal)]
        assert out == batch_anchors(mine, 5.0, 7, 100)
