"""What the training-data operators share: reading, words, Arrow columns, blobs by partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from emberline.session import configure

#: A word in the sense of most operators, for Spark's and DuckDB's regex functions.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one Arrow batch carries, so that a Python task holds some megabytes of text.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on. They work in steps that each write a table, after which the
    shuffle files of a step are of no more use; Spark deletes them then, not when the driver happens to collect
    its garbage."""
    configure(spark)
    for key, value in {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash with ours;
    rows of an input with fewer parts than cores are dealt out."""
    prepare(docs.sparkSession)
    return docs.select(*columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; a missing id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def split_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; bytes.lower and bytes.split
    know only ASCII. None has no words."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(1 << (n - 1).bit_length(), b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def text_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hash of each word of ``split_words``, whole text at once: differences of a
    running polynomial over the bytes."""
    a = np.frombuffer((text or b"").lower(), np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[a], prepend=True, append=True))
    if not len(edge):
        return np.empty(0, np.uint64)
    up, down = _powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    first, end = edge[::2], edge[1::2]
    return mix64((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` words, in text order; one of the whole
    sequence if there are fewer, none without words."""
    width = min(width, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def slices(values: np.ndarray, parts: np.ndarray, n: int):
    """(part, values of that part) for each part that has any."""
    order = np.argsort(parts, kind="stable")
    values, edges = values[order], np.searchsorted(parts[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), values[edges[p] : edges[p + 1]]
