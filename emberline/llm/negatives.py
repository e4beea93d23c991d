"""Hard negatives for anchors, by exact integer scores.

Vectors are scaled and floored to integers; a score is an inner product. Each row stores its
angles to a few reference directions. The angle between an anchor and a row is at least the
difference of their angles to any reference, and at most their sum, so the references give an
interval of the cosine, which times both norms, rounded outwards, bounds the score. Only rows
whose interval reaches into a wanted window of scores are scored.

Rows are packed into shards of bounded size and anchors into blocks; each block meets each
shard. The meetings are dealt over tiles of some shards by some blocks, a tile a task, so a block
is copied once for each row of tiles and a shard once for each column, and nothing is broadcast.
What a meeting finds is cut to the few best, which a window per anchor merges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.llm.common import narrow
from emberline.plans.storage import Tables, cut

#: Rows of a shard and anchors of a block, on average.
SHARD_ROWS, BLOCK_ANCHORS = 2048, 256
#: Shards and blocks of a tile at most, where there are more than a few tiles for each core.
TILE_SHARDS, TILE_BLOCKS, TILES_PER_CORE = 8, 256, 4
#: Reference directions, and rows among which they are chosen. They decide how many rows are scored, not the result.
REFERENCES, CANDIDATES = 16, 1024
#: Angles are kept in single precision; this is more than their error.
SLACK = 1e-5
#: Larger squared norms could lead to scores that a long doesn't hold.
MAX_SQUARE = 2.0**61
PACKED = "n int, width int, vectors binary, norms binary, angles binary, ids binary, known binary, labels binary, rows binary"


def integers(embeddings: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, a row a vector; shorter ones are filled up with zeros."""
    lists = embeddings.combine_chunks() if isinstance(embeddings, pa.ChunkedArray) else embeddings
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(lengths), lengths.max(initial=0)), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(scale * flat)
    return out


def angles(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of each vector to each reference (a unit vector); 0 for a vector without direction."""
    width = min(vectors.shape[1], references.shape[1])
    cosines = vectors[:, :width] @ references[:, :width].T / np.where(norms, norms, 1)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosines, -1, 1)), 0).astype(np.float32)


def shortest(vectors: np.ndarray) -> bytes:
    """The integers in the fewest bytes that hold each of them."""
    low, high = vectors.min(initial=0), vectors.max(initial=0)
    return vectors.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)).tobytes()


def spread(vectors: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors far apart, a vector and its opposite being the same: the next one is that which the last ones know least about."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    units = vectors[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, vectors.shape[1]))
    chosen, near = [0], np.abs(units @ units[0])
    while len(chosen) < min(count, len(units)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, np.abs(units @ units[chosen[-1]]))
    return units[chosen]


class Side:
    """Vectors of one packed shard or block."""

    def __init__(self, row: dict):
        n = row["n"]
        of = lambda name, kind: np.frombuffer(row[name], kind)
        held = n * row["width"]
        self.vectors = of("vectors", f"i{len(row['vectors']) // held if held else 8}").reshape(n, row["width"]).astype(np.int64)
        self.norms, self.angles = of("norms", np.float64), of("angles", np.float32).reshape(n, -1) if n else None
        self.labels, self.rows = of("labels", np.int64), of("rows", np.int64)
        self.ids, self.known = of("ids", np.int64), of("known", np.bool_)
        # Missing ids come last among equal scores.
        self.places = np.where(self.known, self.ids, np.iinfo(np.int64).max)


def bounds(a: Side, i: np.ndarray, x: Side, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor ``i`` with each row ``j``."""
    near, far = np.zeros((len(i), len(j)), np.float32), np.full((len(i), len(j)), np.pi, np.float32)
    for s, t in zip(a.angles[i].T, x.angles[j].T, strict=True):
        np.maximum(near, np.abs(s[:, None] - t), out=near)
        both = s[:, None] + t
        np.minimum(far, np.minimum(both, 2 * np.float32(np.pi) - both), out=far)
    scale = a.norms[i][:, None] * x.norms[j]
    low = np.cos(np.minimum(far.astype(np.float64) + SLACK, np.pi)) * scale
    high = np.cos(np.maximum(near.astype(np.float64) - SLACK, 0)) * scale
    return np.floor(low - 1e-9 * scale), np.ceil(high + 1e-9 * scale)


def scores(a: Side, i: np.ndarray, x: Side, j: np.ndarray) -> np.ndarray:
    width = min(a.vectors.shape[1], x.vectors.shape[1])
    left, right, out = a.vectors[:, :width], x.vectors[:, :width], np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.einsum("ij,ij->i", left[i[part]], right[j[part]])
    return out


def leading(count: int, owner: np.ndarray, score: np.ndarray, x: Side, j: np.ndarray) -> np.ndarray:
    """Indexes of the ``count`` best of each owner."""
    order = np.lexsort((x.rows[j], x.places[j], -score, owner))
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < count]


def floor_of(count: int, low: np.ndarray) -> np.ndarray:
    """The score that an anchor's ``count`` best rows reach for sure, from lower bounds."""
    if low.shape[1] < count:
        return np.full(len(low), -np.inf)
    return np.partition(low, low.shape[1] - count, axis=1)[:, low.shape[1] - count]


def best_positives(a: Side, x: Side, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, rows and scores of the best rows with an anchor's label, without itself."""
    found = [(np.empty(0, np.int64),) * 3]
    for label in np.intersect1d(a.labels, x.labels):
        i, j = np.flatnonzero(a.labels == label), np.flatnonzero(x.labels == label)
        low, high = bounds(a, i, x, j)
        same = a.rows[i][:, None] == x.rows[j]
        low[same], high[same] = -np.inf, -np.inf
        p, q = np.nonzero((high >= floor_of(count, low)[:, None]) & ~same)
        p, q = i[p], j[q]
        score = scores(a, p, x, q)
        keep = leading(count, p, score, x, q)
        found.append((p[keep], q[keep], score[keep]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def best_negatives(a: Side, x: Side, least: np.ndarray, most: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """Anchors, windows, rows and scores of the best rows of other labels in each window of each anchor."""
    i, j = np.arange(len(a.rows)), np.arange(len(x.rows))
    low, high = bounds(a, i, x, j)
    other = a.labels[:, None] != x.labels
    wanted, found = np.zeros(other.shape, np.bool_), [(np.empty(0, np.int64),) * 4]
    for w in range(least.shape[1]):
        bottom, top = least[:, w, None], most[:, w, None]
        sure = floor_of(count, np.where(other & (low >= bottom) & (high <= top), low, -np.inf))
        wanted |= (high >= np.maximum(bottom, sure[:, None])) & (low <= top)
    p, q = np.nonzero(wanted & other)
    score = scores(a, p, x, q)
    for w in range(least.shape[1]):
        inside = np.flatnonzero((score >= least[p, w]) & (score <= most[p, w]))
        keep = inside[leading(count, p[inside], score[inside], x, q[inside])]
        found.append((p[keep], np.full(len(keep), w), q[keep], score[keep]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _pack(scale: int, references, key: str, positives: int = 0, low: int = 0, high: int = 0):
    """One row from the rows of a shard or block; with ``positives``, also the windows of its anchors."""
    def run(group: pa.Table) -> pa.Table:
        vectors = integers(group["embedding"], scale)
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        ids = group["vec_id"].combine_chunks()
        columns = {
            key: group[key][:1], "n": [len(vectors)], "width": [vectors.shape[1]], "vectors": [shortest(vectors)],
            "norms": [norms.tobytes()], "angles": [angles(vectors, norms, references.value).tobytes()],
            "ids": [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
            "known": [ids.is_valid().to_numpy(zero_copy_only=False).tobytes()],
            "labels": [group["label"].to_numpy().astype(np.int64).tobytes()], "rows": [group["row"].to_numpy().astype(np.int64).tobytes()],
        }
        if positives:
            # An anchor without so many positives gets windows that nothing is in.
            least, most = np.ones((len(vectors), positives), np.int64), np.zeros((len(vectors), positives), np.int64)
            for k, found in enumerate(group["scores"].to_pylist()):
                for p, score in enumerate(found):
                    least[k, p], most[k, p] = -(-low * score // 100), high * score // 100
            columns |= {"least": [least.tobytes()], "most": [most.tobytes()]}
        kind = lambda name: pa.int32() if name in (key, "n", "width") else pa.binary()
        return pa.table(columns, pa.schema([(name, kind(name)) for name in columns]))

    return run


def _meet(shards: DataFrame, blocks: DataFrame, count: int, wide: int, work, schema: str) -> DataFrame:
    """``work(block, shard)`` for each of the ``wide`` blocks and each of the ``count`` shards."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int32() if f.endswith(" int") else pa.int64() for f in schema.split(", ")]
    down = min(count, max(TILES_PER_CORE * shards.sparkSession.sparkContext.defaultParallelism, math.ceil(count / TILE_SHARDS)))
    across = math.ceil(wide / TILE_BLOCKS)
    # Both sides come with the task of their tile, so that Spark sends neither of them whole to every executor: before it
    # runs, the blocks are taken for as small as they are without their copies.
    each = lambda n, place: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: place(k).cast("int"))).alias("tile")
    dealt = shards.select(F.struct(*shards.columns).alias("side"), each(across, lambda k: F.col("shard") % down * across + k))
    copied = blocks.select(F.struct(*blocks.columns).alias("anchors"), each(down, lambda k: k * across + F.col("block") % across))
    pairs = (
        dealt.repartitionById(down * across, "tile").hint("merge").join(copied.repartitionById(down * across, "tile"), "tile")
        .select("side", "anchors")
    )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                side, anchors = (batch.column(c)[k].as_py() for c in (0, 1))
                columns = work(anchors, Side(anchors), Side(side))
                yield pa.RecordBatch.from_arrays([pa.array(c, t, mask=m) for (c, m), t in zip(columns, kinds, strict=True)], names=names)

    return pairs.mapInArrow(run, schema)


def mine(
    vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, label, embedding``; ``anchor`` tells the rows that are anchors (null: no).
    For each anchor and each of its ``positives`` best other rows of the same label, the ``negatives`` best
    rows of another label whose score is from ``low`` to ``high`` hundredths of the positive's. Equal scores
    go by the smaller ``vec_id``, missing ids last.

    Rows without label or vector, with a component that is null or not finite, or so long that a score
    might not fit a long (a squared norm of 2^61 after scaling) take no part. Of vectors of different lengths
    the common part counts. Repeated rows are rows of their own. Other columns are not read.
    """
    spark, kept = vectors.sparkSession, Tables(vectors.sparkSession)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") * scale, F.lit(2)))
    # False for a sum that is null, not a number or infinite.
    usable = F.col("label").isNotNull() & (F.coalesce(square, F.lit(MAX_SQUARE)) < MAX_SQUARE)
    flagged = vectors.withColumn("anchor", F.coalesce(anchor, F.lit(False))).select("vec_id", "label", "embedding", "anchor")
    rows = kept.cut(narrow(flagged.filter(usable), *flagged.columns).withColumn("row", F.monotonically_increasing_id()))
    total, anchored = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    sample = rows.orderBy(F.xxhash64("row")).limit(CANDIDATES).select("embedding").toArrow()["embedding"]
    references = spark.sparkContext.broadcast(spread(integers(sample, scale), REFERENCES))

    count, blocks = max(1, math.ceil(total / SHARD_ROWS)), max(1, math.ceil(anchored / BLOCK_ANCHORS))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    shards = kept.cut(rows.withColumn("shard", part(count)).groupBy("shard").applyInArrow(_pack(scale, references, "shard"), f"shard int, {PACKED}"))
    anchors = rows.filter("anchor").withColumn("block", part(blocks))
    packed = anchors.groupBy("block").applyInArrow(_pack(scale, references, "block"), f"block int, {PACKED}")

    def nearest(_, a, x):
        i, j, score = best_positives(a, x, positives)
        return (a.rows[i], None), (x.rows[j], None), (x.ids[j], ~x.known[j]), (score, None)

    order = [F.desc("score"), F.asc_nulls_last("id"), "found"]
    first = Window.partitionBy("row").orderBy(*order)
    best = kept.cut(
        _meet(shards, packed, count, blocks, nearest, "row long, found long, id long, score long")
        .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    )
    wanted = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("scores"))
    windows = anchors.join(wanted, "row").groupBy("block").applyInArrow(
        _pack(scale, references, "block", positives, low, high), f"block int, {PACKED}, least binary, most binary")

    def between(packed, a, x):
        least, most = (np.frombuffer(packed[k], np.int64).reshape(len(a.rows), positives) for k in ("least", "most"))
        i, w, j, score = best_negatives(a, x, least, most, negatives)
        return (a.rows[i], None), (w + 1, None), (x.rows[j], None), (x.ids[j], ~x.known[j]), (score, None)

    each = Window.partitionBy("row", "place").orderBy(*order)
    hard = (
        _meet(shards, windows, count, blocks, between, "row long, place int, found long, id long, score long")
        .withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= negatives)
        .select("row", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    )
    named = best.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "row", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    result = cut(hard.join(named, ["row", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    kept.drop_all()
    return result
