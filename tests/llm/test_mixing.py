"""Targets by a plain water-filling loop, the mix by plain permutations and blocks, reruns."""

from pyspark.sql import functions as F

from emberline.llm import mixing
from emberline.llm.mixing import mix, permuted


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_mix(table):
    rows = [(i, "w " * (i % 50), None if i % 11 == 0 else f"s{i % 7}" if i % 3 else "s0", "x") for i in range(3000)]
    rows += [(1, "w " * 9, "s1", "x")] * 2 + [(None, "a b", "s2", "x"), (9001, None, "s3", "x"), (9002, "w " * 5000, "s4", "x")]
    df = table(rows, "doc_id long, text string, source string, size string")
    got = mix(df).collect()
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(round(r.target, 4) for r in got) == sorted(round(want[s], 4) for _, _, s, _ in rows)
    for source, aim in want.items():
        # Equal targets can't be told apart in the result, so what is taken is added up over them.
        alike = sum(abs(want[x] - aim) < 1e-6 for x in want)
        took = sum(r.taken for r in got if abs(r.target - aim) < 1e-6)
        assert abs(took - alike * aim) <= alike * 2 * mixing.BLOCK, source
    assert all((r.first_shard is None) == (r.taken == 0) for r in got)
    assert sorted(map(str, mix(df).collect())) == sorted(map(str, got))
    assert mix(df.limit(0)).count() == 0


def test_one_source_and_none(table):
    for source in (None, "only"):
        rows = [(i, "w " * (i % 40), source) for i in range(400)]
        got = mix(table(rows, "doc_id long, text string, source string")).collect()
        size = sum(i % 40 for i in range(400))
        assert {r.target for r in got} == {1.5 * size} and abs(sum(r.taken for r in got) - 1.5 * size) <= 2 * mixing.BLOCK
    empty = mix(table([(1, None, "a"), (2, " ", None), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken, r.first_shard) for r in empty] == [(0, 0.0, 0, None)] * 3


def test_permutation(spark):
    for n in (1, 2, 3, 31, 1000):
        places = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"))).collect()]
        assert sorted(places) == list(range(n))
        other = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit("l"))).collect()]
        assert n < 31 or sum(a == b for a, b in zip(places, other, strict=True)) < n / 5
    # No sum leaves the range of a long, however many blocks a source has.
    n = 9 * 10**18
    far = [r[0] for r in spark.range(50).select(permuted(F.lit(n - 1) - F.col("id"), F.lit(n), F.lit("k"))).collect()]
    assert len(set(far)) == 50 and all(0 <= x < n for x in far)


def test_slots(table):
    """Every pass over a source takes each block once, shards are full, their draws follow the shares."""
    aims = table([("=a", 9000, 9000.0), ("=b", 3000, 6000.0), ("=c", 10, 20.0), ("-", 0, 0.0)], "key string, source_size long, target double")
    got = mixing.slots(aims, shard_slots=64, chunk=50).collect()
    blocks = {"=a": 282, "=b": 94, "=c": 1}
    count = {k: sum(r.key == k for r in got) for k in blocks}
    assert count == {"=a": 282, "=b": 188, "=c": 2} and len(got) == 472
    for key, n in blocks.items():
        for first in range(0, count[key], n):
            assert sorted(r.block for r in got if r.key == key and first <= r.slot < first + n) == list(range(n))
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.key)
    assert sorted(map(len, shards.values())) == [24] + [64] * 7
    a = [sum(k == "=a" for k in x) for x in shards.values() if len(x) == 64]
    assert len(set(a)) > 1 and all(20 < n < 56 for n in a)


def test_permutation_is_the_same(spark):
    """With centres made elsewhere too, each place goes where the definition takes it."""
    n, key = F.lit(700) - F.col("id") % 7, (F.concat(F.lit("="), (F.col("id") % 3).cast("string")), F.lit(17))

    def turn(place, r):
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - place, n)
        return F.when(F.xxhash64(*key, r, F.greatest(place, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(place)

    want = F.aggregate(F.sequence(F.lit(1), F.lit(mixing.ROUNDS)), F.col("id"), turn)
    rows = spark.range(500).withColumn("made", mixing.centres(n, *key))
    got = rows.select("id", permuted(F.col("id"), n, *key), permuted(F.col("id"), n, *key, rounds=F.col("made")), want).collect()
    assert all(a == b == c for _, a, b, c in got) and sum(x != a for x, a, _, _ in got) > 400


def test_the_mix_holds_the_words(table):
    """Every block of the mix is a block of its source's words, document after document; counts are those of the mix."""
    rows = [(i, "\t".join(f"d{i}w{k}" for k in range(i % 90)) + " \n", None if i % 11 == 0 else f"s{i % 3}", "x") for i in range(600)]
    rows += [(9005, "a  b c", "s1", "x")] * 3 + [(None, "e f", "s2", "x"), (9001, None, "s2", "x"), (9002, " ", "s0", "x"), (9003, "l " * 700, "s0", "x")]
    df = table(rows, "doc_id long, text string, source string, words string")
    made = mixing.mixture(df).collect()
    sized = mixing.with_sizes(df).collect()
    start = {}
    for r in sized:
        start.setdefault((r.source, r.doc_id), []).append(r.start)
    words = {}
    for i, text, source, _ in rows:
        for k, w in enumerate((text or "").split()):
            words.setdefault(source, {})[start[source, i][0] + k] = w
        start[source, i] = start[source, i][1:] if text and text.split() else start[source, i]
    # Starts are without gaps, so the words of a source are one sequence.
    blocks = {s: [[w[k] for k in range(b, min(b + mixing.BLOCK, len(w)))] for b in range(0, len(w), mixing.BLOCK)] for s, w in words.items()}
    places = {}
    for r in made:
        places.setdefault((r.shard, r.place), []).append(r)
    assert sorted(places) == [(k // mixing.SHARD_SLOTS, k % mixing.SHARD_SLOTS) for k in range(len(places))]
    used = {s: [0] * len(b) for s, b in blocks.items()}
    for held in places.values():
        held.sort(key=lambda r: r.at)
        source, found = held[0].source, " ".join(r.words for r in held).split()
        assert {r.source for r in held} == {source} and [r.at for r in held] == [sum(len(x.words.split()) for x in held[:k]) for k in range(len(held))]
        used[source][blocks[source].index(found)] += 1
    assert all(max(u) - min(u) <= 1 and max(u) <= mixing.MAX_REPEATS for s, u in used.items() if len({tuple(b) for b in blocks[s]}) == len(u))
    took = {}
    for r in made:
        took[r.source, r.doc_id] = took.get((r.source, r.doc_id), 0) + len(r.words.split())
    taken = {}
    for r in mix(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {i: n for i, n in taken.items() if n} == {i: n for (_, i), n in took.items()}
