"""Ranked lexical search of documents for the terms of many items.

Documents are indexed in blocks: each term's positions and frequencies, documents in order of
their id. An item meets a block as follows. The bitmaps of its terms give each document the
mask of the terms it holds, and documents of one mask form a group. A mask's score is at most
the sum of its terms' highest parts in the block. Groups are scored in descending order of
that sum, until the last of the best documents so far is above the next sum.
"""

from __future__ import annotations

from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberline.llm.common import as_bytes, narrow
from emberline.plans.storage import Tables, cut

#: A term, for Spark's regex functions, and which letters are lower-cased.
TERM, UPPER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same for UTF-8 bytes: what isn't part of a term becomes a space.
FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()
#: Documents of a block, and postings after which a block ends sooner. Positions have 16 bits.
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 4096, 1 << 20
#: Items that meet a block together, and groups of such items whose best documents a task keeps at hand.
ITEMS, HELD = 128, 64
#: Bytes of distinct terms of all items that go to each task, so that only these are indexed. Of items with
#: more terms than that, every term of the documents is.
MAX_TERMS = 32 << 20
#: The first groups scored together hold about so many documents.
FIRST = 64


def words(data: bytes | None) -> list[bytes]:
    return data.translate(FOLD).split() if data else []


class Builder:
    """Postings of the documents of one block."""

    def __init__(self, terms: frozenset | None):
        self.terms = terms
        self.clear()

    def clear(self) -> None:
        self.seen = self.total = self.postings = 0
        self.ids, self.sizes, self.positions, self.frequencies = [], [], {}, {}

    def add(self, doc_id, data: bytes | None) -> None:
        found = words(data)
        if not found:
            return
        self.seen += 1
        self.total += len(found)
        counts = Counter(found if self.terms is None else filter(self.terms.__contains__, found))
        if not counts:
            return
        at = len(self.ids)
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.postings += len(counts)
        for term, n in counts.items():
            if term in self.positions:
                self.positions[term].append(at)
                self.frequencies[term].append(n)
            else:
                self.positions[term], self.frequencies[term] = [at], [n]

    @property
    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCUMENTS or self.postings >= BLOCK_POSTINGS

    def row(self, kind: pa.DataType) -> list:
        """The columns of the block's row; documents come in order of their id, missing ids last."""
        ids = pa.array(self.ids, kind)
        order = pc.array_sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms = list(self.positions)
        counts = np.fromiter(map(len, self.positions.values()), np.int64, len(terms))
        at = place[np.fromiter((p for t in terms for p in self.positions[t]), np.int64, self.postings)]
        often = np.fromiter((n for t in terms for n in self.frequencies[t]), np.int64, self.postings)
        inside = np.lexsort((at, np.repeat(np.arange(len(terms)), counts)))
        sizes = np.array(self.sizes, np.int64)[order]
        return [self.seen, self.total, ids.take(pa.array(order)).to_pylist(), sizes.tolist(), terms, counts.tolist(),
                at[inside].astype(np.uint16).tobytes(), often[inside].astype(np.int64).tobytes()]


def index(docs: DataFrame, terms: frozenset | None = None) -> DataFrame:
    """A row for each block of documents; with ``terms`` only these are indexed, though all words count."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        builder, arrow = Builder(shared.value), pa.int64()
        of = lambda: [pa.int64(), pa.int64(), pa.list_(arrow), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["documents", "words", "ids", "sizes", "terms", "counts", "positions", "frequencies"]
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(builder.row(arrow), of(), strict=True)], names=names)
        for batch in batches:
            arrow = batch.schema.field(0).type
            for doc_id, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                builder.add(doc_id, data)
                if builder.full:
                    yield emit()
                    builder.clear()
        if builder.seen:
            yield emit()

    return narrow(docs, "doc_id", "text").mapInArrow(
        run, f"documents long, words long, ids array<{kind}>, sizes array<long>, terms array<binary>, counts array<long>, positions binary, frequencies binary")


class Block:
    """A block's postings with the part of the score that each adds, before its term's weight."""

    def __init__(self, row: dict, documents: int, total: int):
        self.ids = row["ids"]
        ends = np.cumsum([0, *row["counts"]])
        self.places = {t: (int(a), int(b)) for t, a, b in zip(row["terms"], ends, ends[1:], strict=False)}
        self.positions = np.frombuffer(row["positions"], np.uint16).astype(np.int64)
        often = np.frombuffer(row["frequencies"], np.int64)
        # Python's integers, as the product may not fit 64 bits.
        sizes = np.array([100 - 90 + 90 * n * documents // total for n in row["sizes"]], np.int64)
        self.parts = 1_000_000_000 * often // (1000 * often + 8 * sizes[self.positions]) if len(often) else often
        self.most = dict(zip(row["terms"], np.maximum.reduceat(self.parts, ends[:-1]).tolist(), strict=True)) if len(often) else {}

    def grouped(self, held: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents with any of the terms, those of one mask together; where groups end; and the highest
        possible score of each document's group, descending."""
        masks, sums, bit = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64), 16
        for first, end, _, most in held:
            if bit == 63:
                # The bits so far become the number of their combination, which 16 bits hold.
                masks, bit = np.unique(masks, return_inverse=True)[1], 16
            at = self.positions[first:end]
            masks[at] |= 1 << bit
            sums[at] += most
            bit += 1
        places = np.flatnonzero(sums)
        places = places[np.lexsort((masks[places], -sums[places]))]
        return places, np.append(np.flatnonzero(np.diff(masks[places])) + 1, len(places)), sums[places]

    def scores(self, held: list[tuple[int, int, int, int]], places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for first, end, weight, _ in held:
            at = first + np.minimum(np.searchsorted(self.positions[first:end], places), end - first - 1)
            out += np.where(self.positions[at] == places, weight * self.parts[at], 0)
        return out

    def search(self, terms: list[tuple[bytes, int]], count: int, floor: int) -> list[tuple[int, int]]:
        """(score, place) of the best ``count`` documents with a score above 0, ties by place. Documents
        under ``floor`` may be left out."""
        held = [(*self.places[t], w, w * self.most[t]) for t, w in terms if t in self.places]
        floor, best = max(floor, 1), []
        if sum(most for *_, most in held) < floor:
            return best
        places, ends, sums = self.grouped(held)
        start, want = 0, FIRST
        while start < len(places) and sums[start] >= floor:
            # Whole groups, at least so many documents.
            end = int(ends[min(np.searchsorted(ends, start + want), len(ends) - 1)])
            group = places[start:end]
            score = self.scores(held, group)
            first = np.lexsort((group, -score))[:count]
            best = sorted([*best, *((-int(score[k]), int(group[k])) for k in first if score[k] > 0)])[:count]
            if len(best) == count:
                floor = max(floor, -best[-1][0])
            start, want = end, 2 * want
        return [(-score, place) for score, place in best]


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term``: the distinct terms of each row's text; ``item`` numbers the rows."""
    found = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(f"({TERM})"), F.lit(1)))
    numbered = items.withColumn("item", F.monotonically_increasing_id())
    return numbered.select("item", "item_id", F.explode(found).alias("term")).withColumn("term", F.col("term").cast("binary"))


def vocabulary(terms: DataFrame, limit: int = MAX_TERMS) -> frozenset | None:
    """The distinct terms, if they and 64 bytes for each are within ``limit``."""
    distinct = terms.select("term").distinct()
    size = distinct.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    return frozenset(bytes(r.term) for r in distinct.collect()) if size <= limit else None


def search(docs: DataFrame, items: DataFrame, count: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` the ``count`` best documents.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document adds to its score, for each distinct
    term of the item that it holds tf times, weight * ((10^9 tf) div (1000 tf + 8m)), where m is 10 +
    (90 n N) div L. N documents have terms, L in all, n in this one.

    Equal scores go by ascending ``doc_id``, missing ids last. Documents or items without terms (null, empty)
    have no part in it; repeated documents and items are rows of their own. Other columns are not read. Texts
    of any length are indexed whole. A task holds a block of documents and some blocks of items.
    """
    kept = Tables(docs.sparkSession)
    terms = kept.cut(item_terms(narrow(items, "item_id", "text")))
    blocks = kept.cut(index(docs, vocabulary(terms)))
    documents, total, rows = blocks.agg(F.sum("documents"), F.sum("words"), F.count(F.lit(1))).first()
    documents, total = documents or 0, total or 1

    often = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).alias("weight")
    weighed = terms.join(often, "term").select("item", "term", weight).filter("weight > 0")
    parts = max(1, -(-terms.select("item").distinct().count() // ITEMS))
    asked = weighed.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    asked = asked.groupBy(F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("item", "terms")).alias("asked"))
    dealt = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(rows - 1, 0)))))
    slot = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(rows, 1))).cast("int").alias("slot")
    met = blocks.select("ids", "sizes", "terms", "counts", "positions", "frequencies", slot).join(dealt, "slot").drop("slot")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        held: OrderedDict[int, dict[int, list]] = OrderedDict()
        arrow = pa.int64()

        def emit(best: dict[int, list]) -> pa.RecordBatch:
            flat = [(item, doc_id, score) for item, found in best.items() for score, doc_id in found]
            columns = zip(*flat, strict=True) if flat else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), arrow, pa.int64()), strict=True)], names=["item", "doc_id", "score"])

        for batch in batches:
            arrow = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
                block, part = Block(row, documents, total), row["part"]
                if part not in held and len(held) >= HELD:
                    yield emit(held.popitem(last=False)[1])
                best = held.setdefault(part, {})
                for item in row["asked"]:
                    known = best.get(item["item"], [])
                    floor = known[-1][0] if len(known) == count else 0
                    found = block.search([(t["term"], t["weight"]) for t in item["terms"]], count, floor)
                    if found:
                        known = known + [(score, block.ids[place]) for score, place in found]
                        best[item["item"]] = sorted(known, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:count]
        for best in held.values():
            yield emit(best)

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = met.mapInArrow(run, f"item long, doc_id {kind}, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)
    names = terms.select("item", "item_id").distinct()
    result = cut(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    kept.drop_all()
    return result
