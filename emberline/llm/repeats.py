"""Byte strings that occur more than once, removed from documents.

Every string of ``length`` bytes has an anchor: the smallest hash of its short grams. Equal
strings have equal anchors, so strings are compared only under one anchor. Neighbouring
strings with the same anchor make a stretch; equal stretches are counted as one class before
anything moves. Where an anchor has several classes, their bytes go to one block, whose
Burrows-Wheeler transform gives the common prefixes by increasing value, from the seeds up to
``length``: what is still open then is repeated. Anchors with more classes than a block
should hold are split further: their stretches are cut at fixed distances from the anchor,
equal parts become one, and where different parts have the bytes in common that all their
strings hold, the strings are dealt by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from zstandard import ZstdCompressor, ZstdDecompressor

from emberline.llm.common import _BYTE, _powers, as_bytes, mix64, narrow, partitions, record_batch
from emberline.plans.storage import cut, tables

LENGTH = 200
#: Bytes of a gram; windows are far apart if grams are short, and anchors are rarer in common if they are long.
GRAM = 32
#: String starts that one step over a long text takes, so that its arrays stay small.
CHUNK = 1 << 20
#: Classes under one anchor that go into a block together; beyond, strings are dealt by their own hash.
MAX_CLASSES = 512
#: Strings of a part of a stretch under a crowded anchor.
PART = 16
#: Symbols of a block; a position in it has to fit 24 bits.
BLOCK = 2 << 20
_SEED, _BITS, _AT = 7, 9, 24


def _hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial over the bytes and the inverse powers that move a part of it to its start."""
    up, down = _powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return total, down


def stretches(a: np.ndarray, length: int, gram: int):
    """(anchor, content hash, first string, number of strings) of each stretch, as arrays.

    All strings of ``length`` bytes are in one stretch each; a text longer than a step only
    has stretches cut at its ends.
    """
    for at in range(0, len(a) - length + 1, CHUNK):
        part = a[at : at + CHUNK + length - 1]
        total, down = _hashes(part)
        n, width = len(part) - gram + 1, length - gram + 1
        grams = mix64((total[gram:] - total[:n]) * down[:n])
        low = np.uint64((1 << 21) - 1)
        order = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
        order[:n] = (grams & ~low) | np.arange(n, dtype=np.uint64)
        rows = order.reshape(-1, width)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - length + 1
        anchor = (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(first, append=m)
        end = first + count + length - 1
        content = mix64((total[end] - total[first]) * down[first] + count.astype(np.uint64))
        yield grams[anchor[first]].view(np.int64), content.view(np.int64), first + at, count


def _suffixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rotations by their first ``length`` symbols or more, by doubling, and
    whether each differs from the one before within the seed."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    for k in range(_SEED):
        key = (key << np.uint64(_BITS)) | np.roll(symbols, -k).astype(np.uint64)
    order = np.argsort(key)
    apart = np.concatenate(([True], np.diff(key[order]) != 0))
    new, known = apart, _SEED
    while known < length:
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        key = (rank << np.uint64(32)) | np.roll(rank, -known)
        order = np.argsort(key)
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        known *= 2
    return order, apart


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` symbols from each position on also start at another one.

    Breadth first over intervals of rotations that share a prefix: all intervals of one
    prefix length are extended backwards by each symbol in one step. An interval whose end
    has no common-prefix value yet gives it its length and goes on; others stop. After the
    step below ``length``, ends without a value have common prefixes of at least that length.
    """
    n = len(symbols)
    order, apart = _suffixes(symbols, length)
    bwt = symbols[order - 1]
    last_to_first = np.empty(n, np.int64)
    last_to_first[np.argsort(bwt, kind="stable")] = np.arange(n)
    open_ = np.ones(n + 1, bool)
    open_[:-1] = ~apart
    open_[n] = False
    low = np.flatnonzero(apart)
    high = np.append(low[1:], n) - 1
    for _ in range(_SEED, length):
        if not len(low) or not open_.any():
            break
        one = low == high
        alone = last_to_first[low[one]]
        low, high = low[~one], high[~one]
        sizes = high - low + 1
        owner = np.repeat(np.arange(len(low)), sizes)
        member = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)
        packed = np.sort((((owner << _BITS) | bwt[member]) << _AT) | last_to_first[member])
        edge = np.flatnonzero(np.diff(packed >> _AT)) if len(packed) else np.empty(0, np.int64)
        row = packed & ((1 << _AT) - 1)
        ends = np.append(edge, len(row) - 1) if len(row) else edge
        starts = np.append(0, edge + 1) if len(row) else edge
        low, high = np.append(alone, row[starts]), np.append(alone, row[ends])
        fresh = open_[high + 1]
        low, high = low[fresh], high[fresh]
        open_[high + 1] = False
    found = np.empty(n, bool)
    found[order] = open_[:-1] | open_[1:]
    return found


def _runs(flags: np.ndarray) -> list[int]:
    """first, end, first, end, ... of the runs of true flags."""
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)).tolist()


def _block(texts: list[bytes], length: int) -> list[list[int]]:
    """Runs of repeated starts in each text; equal starts in the same or another text count."""
    symbols = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0) for t in texts])
    found, at, out = repeated_starts(symbols, length), 0, []
    for t in texts:
        out.append(_runs(found[at : at + len(t) - length + 1]))
        at += len(t) + 1
    return out


def _packed(rows: DataFrame) -> DataFrame:
    """``uid, doc_id, text`` with the text compressed, as it is stored once and moved twice."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        tool = ZstdCompressor()
        for batch in batches:
            packed = pa.array([x and tool.compress(x) for x in as_bytes(batch.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["uid", "doc_id", "text"])

    return rows.mapInArrow(run, f"uid long, doc_id {kind}, text binary")


def _texts(column: pa.Array):
    """The texts of a compressed column, one at a time; empty for null."""
    tool = ZstdDecompressor()
    return (tool.decompress(x) if x else b"" for x in as_bytes(column))


def _stretch_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = pa.schema([("uid", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            rows, waiting = [], 0
            for uid, data in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                for found in stretches(np.frombuffer(data, np.uint8), length, gram):
                    rows.append((np.full(len(found[0]), uid), *found))
                    waiting += len(found[0])
                    if waiting > 1 << 18:
                        yield record_batch(schema, *map(np.concatenate, zip(*rows, strict=True)))
                        rows, waiting = [], 0
            if rows:
                yield record_batch(schema, *map(np.concatenate, zip(*rows, strict=True)))

    return docs.select("uid", "text").mapInArrow(run, "uid long, anchor long, content long, first long, n long")


def _parts(piece: bytes, n: int, length: int, gram: int) -> list[dict]:
    """The n strings of a stretch by distance from its anchor: first string, hash of the
    part, hash of its core, hash of each string. Equal parts of other stretches have equal hashes.
    The core is what all strings of these distances hold, so equal strings have equal cores."""
    total, down = _hashes(np.frombuffer(piece, np.uint8))
    width = length - gram + 1
    grams = mix64((total[gram : gram + width] - total[:width]) * down[:width])
    lead = int(np.argmin(grams >> np.uint64(21)))
    strings = mix64((total[length:] - total[:n]) * down[:n])
    cuts = [0, *range((lead % PART) or PART, n, PART), n]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        whole = mix64((total[b + length - 1] - total[a : a + 1]) * down[a : a + 1] + np.uint64(b - a))
        start = a - (a - lead) % PART
        core = mix64((total[start + length : start + length + 1] - total[start + PART - 1]) * down[start + PART - 1] + np.uint64(lead - start + PART))
        out.append({"first": a, "part": int(whole.view(np.int64)[0]), "core": int(core.view(np.int64)[0]), "strings": strings[a:b].view(np.int64).tolist()})
    return out


def _pieces(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """Bytes of one stretch of each wanted class, or hashes of its parts under a crowded anchor."""
    listed = wanted.groupBy("uid").agg(F.collect_list(F.struct("anchor", "content", "first", "n", "crowded")).alias("wanted"))
    part = pa.struct([("first", pa.int64()), ("part", pa.int64()), ("core", pa.int64()), ("strings", pa.list_(pa.int64()))])
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("bytes", pa.binary()), ("parts", pa.list_(part))])

    def run(batches):
        for batch in batches:
            for data, asked in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for k in range(0, len(asked), 4096):
                    rows = []
                    for s in asked[k : k + 4096]:
                        piece = data[s["first"] : s["first"] + s["n"] + length - 1]
                        both = (None, _parts(piece, s["n"], length, gram)) if s["crowded"] else (piece, None)
                        rows.append((s["anchor"], s["content"], *both))
                    yield record_batch(schema, *zip(*rows, strict=True))

    parts = "array<struct<first: long, part: long, core: long, strings: array<long>>>"
    return docs.join(listed, "uid").select("text", "wanted").mapInArrow(run, f"anchor long, content long, bytes binary, parts {parts}")


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of repeated strings of each class, block by block; an anchor's classes are in one block."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("runs", pa.list_(pa.int64()))])

    def solve(rows):
        return record_batch(schema, [r[0] for r in rows], [r[1] for r in rows], _block([r[2] for r in rows], length))

    def run(batches):
        block, group, size = [], [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    block, group = block + group if block else group, []
                    if size >= BLOCK:
                        yield solve(block)
                        block, size = [], 0
                group.append(row)
                size += len(row[2]) + 1
        if block or group:
            yield solve(block + group)

    whole = pieces.filter("bytes is not null").select("anchor", "content", "bytes")
    dealt = whole.repartition(partitions(pieces.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, content long, runs array<long>").filter("size(runs) > 0")


def _crowded(pieces: DataFrame) -> DataFrame:
    """The same for anchors with too many classes. Equal parts are counted first, so that
    only strings of different parts are dealt out, and of these only such with a common core."""
    parts = pieces.filter("parts is not null").select("anchor", "content", F.explode("parts").alias("p")).select("anchor", "content", "p.*")
    distinct = parts.groupBy("anchor", "part").agg(F.count(F.lit(1)).alias("times"), F.first("core").alias("core"), F.first("strings").alias("strings"))
    beside = F.count(F.lit(1)).over(Window.partitionBy("anchor", "core"))
    strings = distinct.withColumn("beside", beside).filter("beside > 1").select("anchor", "part", "times", F.posexplode("strings").alias("k", "string"))
    often = strings.groupBy("anchor", "string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    single = strings.filter("times = 1").join(often, ["anchor", "string"]).groupBy("anchor", "part").agg(F.collect_set("k").alias("k"))
    whole = distinct.filter("times > 1").select("anchor", "part", F.expr("sequence(0, size(strings) - 1)").alias("k"))
    found = parts.select("anchor", "content", "first", "part").join(whole.unionByName(single), ["anchor", "part"])
    runs = F.expr("flatten(transform(k, x -> array(first + x, first + x + 1)))")
    return found.groupBy("anchor", "content").agg(F.flatten(F.collect_list(runs)).alias("runs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """``(uid, doc_id, compressed text)`` of each row, and ``(uid, found)`` of the rows with repeated strings.

    ``found`` lists (start of a stretch, runs of repeated starts in it). Both are stored tables.
    """
    spark = docs.sparkSession
    rows = narrow(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    kept = cut(_packed(rows))
    with tables(spark) as t:
        places = t.cut(_stretch_rows(kept, length, gram))
        classes = places.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("uid", "first", "n")).alias("one"))
        seen = t.cut(classes.select("anchor", "content", "times", "one.*"))
        several = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
        wanted = seen.join(several, "anchor").withColumn("crowded", F.col("classes") > MAX_CLASSES)
        pieces = t.cut(_pieces(kept, wanted, length, gram))
        again = seen.filter("times > 1").select("anchor", "content", F.array(F.lit(0).cast("long"), "n").alias("runs"))
        results = again.unionByName(_compared(pieces, length)).unionByName(_crowded(pieces))
        hits = places.select("uid", "anchor", "content", "first").join(results, ["anchor", "content"])
        found = cut(hits.groupBy("uid").agg(F.collect_list(F.struct("first", "runs")).alias("found")), spark)
    return kept, found


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for each row: the byte ranges that repeated strings
    cover, merged where they touch, and the bytes that are left.

    Strings are judged on the input. A null text is empty; texts under ``length`` bytes are
    kept whole; copies of a longer text all go, the first one too. Rows with null or repeated
    ids are documents of their own; other columns are not read; no rows give no rows.
    """
    kept, found = repeated_spans(docs, length, gram)
    kind = dict(kept.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            sizes, spans, rest = [], [], []
            for data, hits in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                merged = []
                for first, end in sorted(
                    (h["first"] + a, h["first"] + b + length - 1) for h in hits or [] for a, b in zip(h["runs"][::2], h["runs"][1::2], strict=True)
                ):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([first, end])
                edges = [0, *(x for m in merged for x in m), len(data)]
                sizes.append(len(data))
                spans.append([{"first": a, "end": b} for a, b in merged])
                rest.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(rest, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = kept.join(found, "uid", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<first: long, end: long>>, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    return without_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
