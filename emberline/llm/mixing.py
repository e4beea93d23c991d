"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document, are packed into blocks of fixed length, and the mix
is a row of slots, one block each, cut into output shards of equal length. How many slots of a shard
each source fills is a multinomial draw, made under the condition that a source's slots over all
shards come to its target: a keyed permutation of all slots deals the sources' shares over the
shards, which is the same as drawing without replacement. A source's slots are numbered; slot j takes
block perm(j mod blocks), perm being a pseudorandom permutation of the source's blocks, a new one for
each pass over them. Slots and blocks meet in an equi-join on the block's index; what they ask of a
document is gathered by document, whose words are then cut out, so a text moves once. ``mixture`` is
the mix itself, word by word, and what ``mix`` says of a document is counted from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import WORD, narrow, partitions
from emberline.plans.storage import Tables, cut

BLOCK, SHARD_SLOTS, SHARE, MAX_REPEATS, WEIGHTS = 32, 4096, 1.5, 2, (5, 2, 1)
#: Documents of a source are numbered inside this many buckets, so that a large source is no one task.
BUCKETS = 4096
#: Slots made from one row, and rounds of the permutation.
CHUNK, ROUNDS = 8192, 16


def centres(n: Column, *key: Column) -> Column:
    """The rounds of a permutation of 0 to n - 1 and their centres."""
    of = lambda r: F.named_struct(F.lit("round"), r, F.lit("centre"), F.pmod(F.xxhash64(*key, r), n))
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), of)


def permuted(at: Column, n: Column, *key: Column, rounds: Column | None = None) -> Column:
    """Where a pseudorandom permutation of 0 to n - 1 takes ``at``, by swap-or-not rounds: each pairs
    a place with its mirror image about a keyed centre, and a keyed bit decides whether the two change
    places. Exact for every n that a long holds, as sums stay below n. ``rounds`` are its ``centres``,
    if they are at hand."""

    def turn(place, r):
        other = F.pmod(r["centre"] - place, n)
        swap = F.xxhash64(*key, r["round"], F.greatest(place, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(place)

    return F.aggregate(centres(n, *key) if rounds is None else rounds, at, turn)


def identity() -> list[Column]:
    """What a document goes by; rows that agree in it have the same text."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    return [key.alias("key"), F.xxhash64("doc_id").alias("doc"), F.xxhash64("text").alias("tie")]


def with_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, key, doc, tie, size`` and the document's first word ``start`` in its source."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(narrow(docs, "doc_id", "source", "text").select(
        "doc_id", "source", *identity(), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("bucket", F.pmod("doc", F.lit(BUCKETS))))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n")).select(
        "key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry")
    )
    inside = Window.partitionBy("key", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return cut(
        rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(carry, ["key", "bucket"])
        .select("doc_id", "source", "key", "doc", "tie", "size", (F.col("carry") + F.col("ahead")).alias("start"))
    )


def targets(sized: DataFrame, share=SHARE, weights=WEIGHTS, repeats=MAX_REPEATS) -> DataFrame:
    """``key, source_size, target`` of each source: sources by code point, null last, take the
    weights in turn; with the water level L at which all share the total, a target is
    min(repeats * size, L * weight). One row per source goes through the two windows."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    sums = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    cap = (repeats * F.col("source_size")).cast("double")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(cap / F.col("weight"), "key")
    capped = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - capped) / left
    return (
        sums.withColumn("level", level)
        .withColumn("water", F.max(F.when(cap / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
        .select("key", "source_size", F.least(cap, F.coalesce(F.col("water") * F.col("weight"), cap)).alias("target"))
    )


def slots(aims: DataFrame, block=BLOCK, shard_slots=SHARD_SLOTS, chunk=CHUNK, seed=17) -> DataFrame:
    """``shard, place, key, slot, block``: which block of which source fills which place of which shard. A source has
    as many slots as bring its target, none more often than twice a block; only its last block may be
    shorter than the others. One row per source goes through the window; slots come from rows of
    ``chunk`` slots each, dealt over all tasks, so a large source is no one task."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    wanted = F.least(MAX_REPEATS * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        aims.filter("source_size > 0").withColumn("blocks", blocks).withColumn("n", wanted)
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
        .filter("n > 0")
    )
    # Centres are made once for a row of slots.
    spread, own = (F.lit("shards"), F.lit(seed)), lambda turn: (F.col("key"), F.lit(seed), turn)
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("blocks")))
    chunks = shares.select(
        "key", "blocks", "n", "start", "total", centres(F.col("total"), *spread).alias("spread"),
        F.transform(turns, lambda t: centres(F.col("blocks"), *own(t))).alias("turns"),
        F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))).alias("first"))
    each = chunks.repartition(partitions(aims.sparkSession), "key", "first").select(
        "key", "blocks", "start", "total", "spread", "turns",
        F.explode(F.sequence("first", F.least(F.col("first") + chunk, "n") - 1)).alias("slot"),
    ).withColumn("turn", F.floor(F.col("slot") / F.col("blocks")))
    place = permuted(F.col("start") + F.col("slot"), F.col("total"), *spread, rounds=F.col("spread"))
    taken = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), *own(F.col("turn")), rounds=F.element_at("turns", (F.col("turn") + 1).cast("int")))
    return each.select("key", "slot", place.alias("at"), taken.alias("block")).select(
        F.floor(F.col("at") / shard_slots).cast("long").alias("shard"), (F.col("at") % shard_slots).alias("place"), "key", "slot", "block")


def _asked(sized: DataFrame, filled: DataFrame) -> DataFrame:
    """``key, doc, tie, asks``: for each document that the mix takes words of, which words go where."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    pieces = sized.filter("size > 0").select(
        "key", "doc", "tie", "start", (F.col("start") + F.col("size")).alias("end"),
        F.explode(F.sequence(F.floor(F.col("start") / BLOCK), last)).alias("block"),
    )
    low, high = F.greatest("start", F.col("block") * BLOCK), F.least("end", (F.col("block") + 1) * BLOCK)
    return pieces.join(filled.hint("merge"), ["key", "block"]).select(
        "key", "doc", "tie", F.struct(
            "shard", F.col("place").cast("int").alias("place"), (low - F.col("block") * BLOCK).cast("int").alias("at"), "start",
            (low - F.col("start")).cast("int").alias("first"), (high - low).cast("int").alias("n"),
        ).alias("ask"),
    ).groupBy("key", "doc", "tie").agg(F.collect_list("ask").alias("asks"))


def _cut_out(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``shard, place, at, key, start, n, words``: each piece of the mix and its size, with its document's place in its source."""
    by = ["key", "doc", "tie"]
    # Of equal rows one gives the words of all. They are found below the join, which makes a row of them, so once a text.
    texts = (
        narrow(docs, "doc_id", "source", "text").select(*identity(), "text").repartition(partitions(docs.sparkSession), *by)
        .groupBy(*by).agg(F.first("text").alias("text"))
        .select(*by, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("found"))
    )
    each = texts.join(asked.hint("merge"), by).select("key", "found", F.explode("asks").alias("ask")).select("key", "found", "ask.*")
    part = each.select("shard", "place", "at", "key", "start", F.slice("found", F.col("first") + 1, F.col("n")).alias("part"))
    return part.select("shard", "place", "at", "key", "start", F.size("part").cast("long").alias("n"), F.array_join("part", " ").alias("words"))


def _mixture(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sizes, the targets and the mix, each stored."""
    kept, sized = Tables(docs.sparkSession), with_sizes(docs)
    aims = cut(targets(sized))
    # Stored, so that the files of one shuffle are gone before the texts are in another; also, Spark takes the slots for
    # as few as the sources they are made from.
    made = cut(_cut_out(docs, kept.cut(_asked(sized, kept.cut(slots(aims).drop("slot"))))))
    kept.drop_all()
    return sized, aims, made


def mixture(docs: DataFrame) -> DataFrame:
    """``shard, place, at, source, doc_id, words``: the mix. A place of a shard holds a block of up to ``BLOCK`` words, in
    one row for each document they are of; ``at`` is the place of a row's first word in the block, and words are parted by
    one space. Rows come in no order."""
    sized, _, made = _mixture(docs)
    named = sized.filter("size > 0").select("key", "start", "source", "doc_id")
    return made.join(named, ["key", "start"]).select("shard", "place", "at", "source", "doc_id", "words")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_shard`` for each row; ``first_shard`` is the first
    shard that takes words of it, null if none does. ``taken`` counts the row's words in the mix. Null texts have
    size 0, a null source is a source, equal rows each have their place in it, other columns may have any name.
    Reruns agree, as places, draws and permutations depend on the rows alone."""
    sized, aims, made = _mixture(docs)
    taken = made.groupBy("key", "start").agg(
        F.sum("n").alias("took"), F.min("shard").alias("first_shard"))
    some = F.col("size") > 0
    return (
        sized.join(aims, "key").join(taken, ["key", "start"], "left")
        .select("doc_id", "size", "source_size", "target",
                F.when(some, F.coalesce("took", F.lit(0))).otherwise(0).cast("long").alias("taken"),
                F.when(some, F.col("first_shard")).alias("first_shard"))
    )
