"""Quality classifier learnt from trusted positives and unlabelled text.

A small network minimises the non-negative unbiased risk: with class prior p, the risk of
positives is weighted by p, and the risk of unlabelled text as negatives, less the part of
it that hidden positives make up, is not let under zero. The prior is the smallest ratio of
unlabelled to positive mass over the upper regions of a first positive-or-unlabelled score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, held_out, narrow, record_batch

#: Rows that the fit gathers; nothing else of the corpus reaches the driver.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
HIDDEN, STEPS, RATE, DECAY = 12, 400, 0.03, 1e-3
GROUPS = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b" \t", b"\n", b".,;:'", b"!", b"#$%&*", b"|", b"<>{}[]", b"()\"-_/=+@?"]
GROUP_OF = np.full(256, len(GROUPS))
for _i, _g in enumerate(GROUPS):
    GROUP_OF[list(_g)] = _i


def features(data: bytes | None) -> list[float]:
    """Shares of kinds of bytes, word lengths and repetition; an empty text has defined ones."""
    text = data or b""
    share = np.bincount(GROUP_OF[np.frombuffer(text, np.uint8)], minlength=len(GROUPS) + 1) / max(1, len(text))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    starts = set(zip(words, words[1:], words[2:], strict=False))
    n = len(words)
    return [
        *share, np.log1p(n), len(text) / max(1, n), len(set(words)) / max(1, n),
        len(starts) / max(1, n - 2), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)) / 100.0, float(n == 0),
    ]


WIDTH = len(features(b""))


def feature_rows(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            rows = [features(x) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


class Network:
    """One hidden layer; Adam on full batches from a fixed start, so that reruns agree."""

    def __init__(self, mean, scale, seed=5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 0.3, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]

    def forward(self, x):
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[1], -30, 30)))

    def fit(self, x, slope):
        """``slope(g)`` is the derivative of the risk by each row's output."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, STEPS + 1):
            h, g = self.forward(x)
            d = slope(g)
            back = np.outer(d, self.p[2]) * (1 - h * h)
            grads = [z.T @ back + DECAY * self.p[0], back.sum(0), h.T @ d + DECAY * self.p[2], np.array([d.sum()])]
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive mass over upper regions with a fifth of the positives."""
    cuts = np.quantile(positive, np.linspace(0, 0.8, 33))
    return float(np.clip(min((unlabelled >= c).mean() / (positive >= c).mean() for c in cuts), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> tuple[Network, float]:
    x, n = np.concatenate([positive, unlabelled]), len(positive)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    target = np.r_[np.ones(n), np.zeros(len(unlabelled))]
    share = np.where(target > 0, 0.5 / n, 0.5 / len(unlabelled))
    if prior is None:
        first = Network(mean, scale).fit(x, lambda g: share * (sigmoid(g) - target))
        prior = class_prior(first.score(positive), first.score(unlabelled))

    def slope(g):
        s = sigmoid(g)
        bend = s * (1 - s)  # loss(g) = sigmoid(-g), so loss(-g) = s
        hidden = s[n:].mean() - prior * s[:n].mean()
        d = np.empty_like(g)
        if hidden < 0:  # only the negative part is taken back
            d[:n], d[n:] = prior * bend[:n] / n, -bend[n:] / (len(g) - n)
        else:
            d[:n], d[n:] = -2 * prior * bend[:n] / n, bend[n:] / (len(g) - n)
        return d

    return Network(mean, scale).fit(x, slope), prior


def train(docs: DataFrame, labels: DataFrame) -> tuple[Network, float] | None:
    """Fit on rows outside the held-out fold; None without positives or unlabelled rows."""
    order = F.xxhash64("doc_id")
    inside = ~held_out("doc_id", 3, 1) & F.col("doc_id").isNotNull()
    good = labels.filter(inside & (F.col("quality") == 1)).select("doc_id").distinct().orderBy(order, "doc_id").limit(MAX_POSITIVE)
    some = docs.filter(inside).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(MAX_UNLABELLED)
    chosen = good.select("doc_id", F.lit(1).alias("good")).unionByName(some.select("doc_id", F.lit(0).alias("good")))
    few = F.broadcast(chosen.select("doc_id").distinct())  # at most both limits together
    rows = feature_rows(docs.join(few, "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "good").collect()
    positive = np.array([r.x for r in rows if r.good]).reshape(-1, WIDTH)
    unlabelled = np.array([r.x for r in rows if not r.good]).reshape(-1, WIDTH)
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else None


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row's whole text.

    Without anything to learn from, every score is 0.5. Null texts are scored as empty ones;
    repeated and null ids give a row each. Map only after the fit.
    """
    docs = narrow(docs, "doc_id", "text")
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model and model[0])
    kind = dict(docs.dtypes)["doc_id"]
    out = pa.schema([("score", pa.float64())])

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in as_bytes(batch.column(1))]).reshape(-1, WIDTH)
            score = shared.value.score(x) if shared.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *record_batch(out, score).columns], names=["doc_id", "score"])

    scored = docs.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose text scores ``least`` or more, as they are; all, without anything to learn from."""
    model = train(narrow(docs, "doc_id", "text"), labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model[0])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in as_bytes(batch.column(at))]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(shared.value.score(x) >= least, pa.bool_()))

    return narrow(docs, *docs.columns).mapInArrow(run, docs.schema)
