"""Join of documents by the Jaccard coefficient of their word n-grams, exact up to 64-bit hashes.

Documents with the same set are one class, and classes are joined. Two sets over the limit
share one of the first n/5 + 1 entries of any common order of shingles, so a tile is what has
such an entry and a size band in common. Frequent shingles come last in the order. In each
tile all members are first held against one hub; what that links needs no further pairs. The
hub is the member with most of its prefix in common with others, which in a group of edited
copies is the text they were made from, or one near it. Then the members of different
components meet in square sub-tiles of bounded size. Either way a parity bitmap of each set
gives, by its bit count, an upper bound of the overlap, and only the pairs that pass are
decided by intersecting the sorted arrays. A sub-tile gives no pairs but its members that
have one; their texts meet in it again, and give the links that hold them together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest, xxh3_128_digest
from zstandard import ZstdCompressor, ZstdDecompressor

from emberline.llm.common import as_bytes, narrow, shingle_hashes, text_hashes
from emberline.llm.components import components
from emberline.plans.storage import Tables, cut

WIDTH, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Shingles in the prefixes of over FREQUENT among one in SHARE of all texts come last in the order; so many
#: of them at most. The links are the same under any order, this one only keeps the tiles small.
SHARE, FREQUENT, MAX_FREQUENT = 8, 25, 1_000_000
#: Members of one sub-tile, and the ratio of size bands (a little over 5/4, so that linked sizes
#: are in the same or the next band).
TILE, BAND = 512, 1.2501
#: Numbers of classes that go to all machines, so that the texts of no others are moved.
LISTED = 4_000_000
#: Entries of the sets that a sub-tile has at hand at a time.
HELD = 4 << 20
#: Classes that a task remembers as given, and bits of the code that stands for a class while entries are dealt out.
GIVEN, CODE = 1_000_000, 48


def shingles(data: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text_hashes(data), WIDTH))


def class_of(found: np.ndarray) -> bytes:
    return xxh3_128_digest(found.tobytes())


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    n = len(found)
    if not n:
        return found
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        often = frequent[at] == found
        found = np.concatenate([found[~often], found[often]])
    return found[: n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1]


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parity of the members that fall on each bit, two bits or more a member: two bitmaps differ in
    no more bits than the sets differ in members. Halves can be folded, as widths are powers of 2."""
    width = max(512, 1 << (2 * len(found) - 1).bit_length())
    ones = np.bincount((found % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(ones.astype(np.uint8)).view(np.uint64)


def enough(overlap, a, b):
    """4/5 or more of the union."""
    return DENOMINATOR * overlap >= NUMERATOR * (a + b - overlap)


def _not_given(classes: list, given: set) -> list[bool]:
    """Whether each class is the first of its kind, as far as ``given`` remembers; those that are are added."""
    new = []
    for x in classes:
        new.append(x is not None and x not in given)
        if new[-1]:
            if len(given) >= GIVEN:
                given.clear()
            given.add(x)
    return new


def _classified(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``doc_id, n, cls, packed, bits, keys`` of each row: size and class of its set, its compressed text, its bitmap
    and the entries of its prefix, which copies that a task has met before don't repeat. Every text is hashed here,
    and only here if nothing is like it."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        tool, given = ZstdCompressor(3), set()
        for batch in batches:
            texts = as_bytes(batch.column(1))
            sets = [shingles(x) for x in texts]
            classes = [class_of(x) if len(x) else None for x in sets]
            new = _not_given(classes, given)
            columns = [
                pa.array(list(map(len, sets)), pa.int64()), pa.array(classes, pa.binary()),
                pa.array([tool.compress(t) if len(x) else None for t, x in zip(texts, sets, strict=True)], pa.binary()),
                pa.array([bitmap(x).tobytes() if len(x) else None for x in sets], pa.binary()),
                pa.array([prefix(x, shared.value).view(np.int64) if k else None for x, k in zip(sets, new, strict=True)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "cls", "packed", "bits", "keys"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, cls binary, packed binary, bits binary, keys array<long>")


def _often(docs: DataFrame) -> DataFrame:
    """``key`` of the shingles that are frequent in prefixes, the most frequent first."""
    def run(batches):
        for batch in batches:
            found = [prefix(shingles(x), np.empty(0, np.uint64)) for x in as_bytes(batch.column(0)) if x and xxh3_64_intdigest(x) % SHARE == 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["key"])

    counts = docs.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    return counts.filter(F.col("c") > FREQUENT).orderBy(F.desc("c"), "key").limit(MAX_FREQUENT).select("key")


def _near_sizes(a: str, b: str):
    """Sizes of sets that may be linked."""
    return (NUMERATOR * F.col(a) <= DENOMINATOR * F.col(b)) & (NUMERATOR * F.col(b) <= DENOMINATOR * F.col(a))


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``u, v`` that bitmaps let through."""
    def run(batches):
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                least = min(len(x), len(y)) // 8
                folded = [np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, least), 0) for z in (x, y)]
                differ = int(np.bitwise_count(folded[0] ^ folded[1]).sum(dtype=np.int64))
                keep.append(bool(enough((a + b - differ) // 2, a, b)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda cls, n, bits: texts.select(F.col("cls").alias(cls), F.col("n").alias(n), F.col("bits").alias(bits))
    met = pairs.join(side("u", "a", "x"), "u").join(side("v", "b", "y"), "v")
    return met.select("u", "v", "a", "b", "x", "y").mapInArrow(run, "u long, v long")


def _texts_of(classes: DataFrame, rows: DataFrame, kept: Tables) -> DataFrame:
    """``cls, packed`` of the classes that are named in a stored table. Texts that nobody asks for are not moved
    unless the list of the others is long."""
    asked = F.broadcast(classes) if classes.count() <= LISTED else classes
    return kept.cut(rows.select(F.col("row").alias("cls"), "packed").join(asked, "cls", "left_semi"))


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return bool(enough(int((both[1:] == both[:-1]).sum()), len(x), len(y)))


def _linked(pairs: DataFrame, rows: DataFrame, kept: Tables) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar enough. Texts travel, as they are smaller than
    their sets; the rows of one ``u`` come one after the other, so its set is made once."""
    def run(batches):
        last, x, tool = None, None, ZstdDecompressor()
        for batch in batches:
            keep = []
            for u, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if u != last:
                    last, x = u, shingles(tool.decompress(a))
                keep.append(_alike(x, shingles(tool.decompress(b))))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = kept.cut(pairs)
    texts = _texts_of(pairs.select(F.explode(F.array("u", "v")).alias("cls")), rows, kept)
    left = texts.select(F.col("cls").alias("u"), F.col("packed").alias("a"))
    right = texts.select(F.col("cls").alias("v"), F.col("packed").alias("b"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _sub_tiles(batches):
    """``(key, top, lo, hi)`` and the rows of each sub-tile of two or more; they come one after the other."""
    last, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for at, row in zip(zip(*columns[:4], strict=True), zip(*columns[4:], strict=True), strict=True):
            if at != last:
                if len(rows) > 1:
                    yield last, rows
                last, rows = at, []
            rows.append(row)
    if len(rows) > 1:
        yield last, rows


def _near(rows: list, top: int):
    """Pairs of one sub-tile that the sizes and bitmaps let through, each in one band only: a member and
    the later ones that it may be like."""
    kinds = (np.int64, np.int64, np.int64, object, np.int64, np.bool_, np.int64)
    _, n, root, bits, band, early, half = (np.array(c, dtype=k) for c, k in zip(list(zip(*rows, strict=True))[:7], kinds, strict=True))
    least = min(map(len, bits)) // 8
    maps = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least), 0) for x in bits])
    split = half.max() != half.min()
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        j = j[(root[j] != root[i]) & (NUMERATOR * np.maximum(n[j], n[i]) <= DENOMINATOR * np.minimum(n[j], n[i])) & (np.maximum(band[j], band[i]) == top)]
        j = j[(early[j] | (n[j] > n[i])) & (early[i] | (n[i] > n[j]))]
        if split:
            j = j[half[j] != half[i]]
        if len(j):
            differ = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
            j = j[enough((n[j] + n[i] - differ) // 2, n[j], n[i])]
            if len(j):
                yield i, j.tolist()


def _forest(rows: list, top: int) -> list[tuple[int, int]]:
    """Links between members of one sub-tile, no more than hold its components together."""
    tool, sets, held, out = ZstdDecompressor(), {}, 0, []
    parent = {r[2]: r[2] for r in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def entries(k):
        nonlocal held
        if k not in sets:
            if held > HELD:
                sets.clear()
                held = 0
            sets[k] = shingles(tool.decompress(rows[k][7]))
            held += len(sets[k])
        return sets[k]

    for i, others in _near(rows, top):
        for j in others:
            a, b = find(rows[i][2]), find(rows[j][2])
            if a != b and _alike(entries(i), entries(j)):
                parent[a] = b
                out.append((rows[i][0], rows[j][0]))
    return out


def _with_partner(rows: DataFrame) -> DataFrame:
    """The members of each tile ``key, top`` that by sizes, bands and early entries may be like another one. Of such
    two the smaller is early, and the larger is of the top band."""
    of = Window.partitionBy("key", "top")
    sized, on_top = of.orderBy("n"), F.col("band") == F.col("top")
    marked = rows.withColumns({
        "below": F.max(F.when(F.col("early"), F.col("n"))).over(sized.rowsBetween(Window.unboundedPreceding, -1)),
        "above": F.when(on_top, F.lead("n").over(sized)).otherwise(F.min(F.when(on_top, F.col("n"))).over(of)),
    })
    return marked.filter((on_top & _near_sizes("n", "below")) | (F.col("early") & _near_sizes("n", "above"))).drop("below", "above")


def _across(shared: DataFrame, texts: DataFrame, roots: DataFrame, packed: DataFrame, kept: Tables) -> DataFrame:
    """Links ``u, v`` that hold members of different components together, from all pairs in a tile."""
    rows = shared.join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", "band", "early", F.coalesce("root", "cls").alias("root"))
    of = Window.partitionBy("key", "top")
    rows = _with_partner(rows.repartition("key").withColumn("top", F.explode(F.array("band", F.col("band") + 1))))
    rows = rows.withColumns({"m": F.count(F.lit(1)).over(of), "r0": F.min("root").over(of), "r1": F.max("root").over(of)}).filter("r0 <> r1")
    mine = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = (
        rows.withColumn("parts", F.ceil(F.col("m") / TILE).cast("int")).withColumn("mine", mine).withColumn("other", other)
        .join(texts.select("cls", "bits"), "cls")
        .select("key", "top", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "cls", "n", "root", "bits", "band", "early", "mine")
    )
    tile = ["key", "top", "lo", "hi"]

    def members(batches):
        for at, rows in _sub_tiles(batches):
            near = sorted({k for i, j in _near(rows, at[1]) for k in (i, *j)})
            if near:
                columns = zip(*((*at, *rows[k]) for k in near), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found, strict=True)], schema=found)

    def links(batches):
        for at, rows in _sub_tiles(batches):
            pairs = _forest(rows, at[1])
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["u", "v"])

    found = to_arrow_schema(dealt.schema)
    together = lambda df: df.repartition(*tile).sortWithinPartitions(*tile)
    near = kept.cut(together(dealt).mapInArrow(members, dealt.schema))
    return together(near.join(_texts_of(near.select("cls"), packed, kept), "cls").select(*near.columns, "packed")).mapInArrow(links, "u long, v long")


def similar_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row.

    ``component_id`` is the smallest id that links lead to, the row's own included. Texts without
    words (null, empty) link with nothing. Rows with equal texts are linked, equal ids or not; a
    null id is never the smallest unless all ids of the group are null. Other columns are not read.
    """
    kept = Tables(docs.sparkSession)
    docs = narrow(docs, "doc_id", "text")
    frequent = np.sort(np.array([r[0] for r in _often(docs).collect()], np.int64).view(np.uint64))
    # Rows are known by a number, as ids may be missing or repeat.
    rows = kept.cut(_classified(docs, frequent).withColumn("row", F.monotonically_increasing_id()))
    reps = kept.cut(rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n")))
    same = Window.partitionBy("key")
    both = NUMERATOR + DENOMINATOR
    alike = F.col("n") - F.floor((2 * NUMERATOR * F.col("n") + both - 1) / both)
    # Of two linked sets the smaller, if not both, has a common entry among its first n/9 + 1 already.
    # Entries are dealt out as they are read, with a code of the class and a bit that says if they are early.
    # What copies in several tasks repeat drops out where the entries of a key meet, so that no prefix is
    # moved only to find which row stands for a class.
    code = F.shiftrightunsigned(F.xxhash64("cls"), 64 - CODE).alias("code")
    keys = rows.select("n", code, F.posexplode("keys").alias("pos", "key")).select(
        "key", (2 * F.col("code") + (F.col("pos") <= alike).cast("int")).alias("member"))
    before = F.lag("member").over(same.orderBy("member"))
    keys = keys.withColumn("before", before).filter("before IS NULL OR before <> member").withColumn("code", F.shiftright("member", 1))
    # Entries that the same classes share make the same tile, which goes by a hash of its members. Were two
    # tiles to have one hash, they would be one larger tile.
    met = keys.withColumns({
        "c0": F.min("code").over(same), "c1": F.max("code").over(same), "tile": F.bit_xor(F.xxhash64("code")).over(same)}).filter("c0 <> c1")
    members = met.groupBy("tile", "code").agg(F.count(F.lit(1)).alias("entries"), (F.max(F.col("member") % 2) == 1).alias("early"))
    # From here on a class is known by the number of its row. Classes of one code all get what the code has, and are
    # compared with each other, as an entry that only they share is not seen as shared.
    band = F.floor(F.log("n") / float(np.log(BAND)))
    shared = kept.cut(members.join(reps.select(code, F.col("row").alias("cls"), "n"), "code").select(
        F.col("tile").alias("key"), "cls", "n", band.alias("band"), "entries", "early"))
    common = shared.groupBy("cls").agg((F.sum("entries") / (F.first("n") / DENOMINATOR + 1)).alias("common"))
    texts = kept.cut(rows.select(F.col("row").alias("cls"), "n", "bits").join(common, "cls", "left_semi"))

    # A tile's hub is the best of its band and the one below; so every member meets a hub or two, and
    # the members of neighbouring bands meet the same one.
    best = F.max(F.struct("common", F.xxhash64("cls").alias("h"), "cls", "n", "early")).alias("best")
    tiles = shared.join(common, "cls").groupBy("key", "band").agg(best)
    order, other = Window.partitionBy("key").orderBy("band"), F.struct("band", "best")
    beside = lambda at, step: F.when(at["band"] == F.col("band") + step, F.greatest("best", at["best"])).otherwise(F.col("best"))
    hubs = tiles.withColumns({"low": F.lag(other).over(order), "high": F.lead(other).over(order)}).select(
        "key", "band", F.array_distinct(F.array(beside(F.col("low"), -1), beside(F.col("high"), 1))).alias("hubs"))
    stars = shared.select("key", "band", "cls", "n", "early").join(hubs, ["key", "band"]).select(F.explode("hubs").alias("hub"), "cls", "n", "early").select(
        F.col("hub.cls").alias("u"), F.col("cls").alias("v"), F.col("hub.n").alias("a"), F.col("n").alias("b"), F.col("hub.early").alias("ua"), F.col("early").alias("vb"))
    # The smaller one, or both of one size, must be early, as in the sub-tiles.
    stars = stars.filter("u <> v AND (ua OR a > b) AND (vb OR b > a)").filter(_near_sizes("a", "b")).select("u", "v").distinct()
    coded = lambda at: reps.select(code, F.col("row").alias(at))
    twins = coded("u").join(coded("v"), "code").filter("u < v").select("u", "v")
    links = kept.cut(_linked(_possible(stars, texts).unionByName(twins), rows, kept))
    roots = components(links, kept)
    more = _across(shared, texts, roots, rows, kept)
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), kept)

    names = reps.join(roots, F.col("row") == F.col("node"), "left").select("cls", F.coalesce("root", "row").alias("root"), "doc_id")
    first = names.groupBy("root").agg(F.min("doc_id").alias("first"))
    ids = names.join(first, "root").select("cls", "first")
    result = cut(rows.select("doc_id", "n", "cls").join(ids, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id")))
    kept.drop_all()
    return result


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each group, that with the smallest id (of equal ids, or none at all, the first row); a row
    without an id stands for its group only if all are. Texts without words all stay."""
    kept = Tables(docs.sparkSession)
    rows = kept.cut(narrow(docs, *docs.columns).select(F.struct(*docs.columns).alias("document"), F.monotonically_increasing_id().alias("row")))
    # As ids, these are unique, and their order is that of the ids with the missing ones last.
    doc_id = F.col("document.doc_id")
    named = rows.select(F.struct(doc_id.isNull().alias("missing"), doc_id.alias("id"), "row").alias("doc_id"), F.col("document.text").alias("text"))
    first = similar_groups(named).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias("first"))
    result = cut(rows.join(first, F.col("row") == F.col("first"), "left_semi").select("document.*"))
    kept.drop_all()
    return result
