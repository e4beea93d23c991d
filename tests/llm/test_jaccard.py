"""Components against all pairs, by plain sets."""

import random

from pyspark.sql import functions as F
from zstandard import ZstdCompressor

from emberline.llm import jaccard
from emberline.plans.storage import Tables


def plain(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(x for x in (low.get(find(i)), doc_id) if x is not None) if (low.get(find(i)), doc_id) != (None, None) else None
    return sorted((str(rows[i][0]), len(sets[i]), str(low[find(i)] if sets[i] else rows[i][0])) for i in range(len(rows)))


def check(table, rows):
    df = table([(a, b, 1) for a, b in rows], "doc_id long, text string, n long").withColumnRenamed("n", "cls")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_groups(df).collect())
    assert got == plain(rows)


def test_groups(table, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    shared = rng.choices(words, k=30)
    rows = [(9000, None), (9001, ""), (9002, " \n"), (9003, "A b"), (9004, "a  B"), (None, "a b"), (9004, "other text"), (9005, "x " * 20000)]
    for i in range(60):
        base = rng.choices(words, k=rng.randint(6, 90)) + (shared if i % 2 else [])
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy[: len(copy) - rng.randint(0, 6)])))
    check(table, rows)
    check(table, rows[:3])


def test_empty_table(table):
    assert jaccard.similar_groups(table([], "doc_id long, text string")).collect() == []


def test_one_row_a_group(table):
    """Repeated rows, ids that stand for several texts, and missing ids."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(1, text(1), "a"), (1, text(1), "a"), (1, text(2), "b"), (2, text(2), "c"), (2, text(3) + " x", "d"), (3, text(3), "e"),
            (None, text(4), "f"), (None, text(4), "g"), (None, text(5), "h"), (7, text(5), "i"), (8, None, "j"), (8, None, "k"), (None, "", "l")]
    got = jaccard.one_per_group(table(rows, "doc_id long, text string, document string")).collect()
    assert [r.asDict().keys() for r in got][0] == {"doc_id": 0, "text": 0, "document": 0}.keys()
    kept = sorted(r.document for r in got)
    assert kept in (["a", "b", "d", x, "i", "j", "k", "l"] for x in "fg"), kept


def test_sub_tile_gives_no_more_than_its_members():
    """A group of near copies is held together by as many links as it has members, not by all its pairs."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(150)] = f"x{i}"
        text = " ".join(copy).encode()
        found = jaccard.shingles(text)
        rows.append((i, len(found), i, jaccard.bitmap(found).tobytes(), 21, True, 0, ZstdCompressor().compress(text)))
    assert sum(len(j) for _, j in jaccard._near(rows, 21)) > 39
    links = jaccard._forest(rows, 21)
    root = list(range(40))
    for u, v in links:
        root = [root[v] if x == root[u] else x for x in root]
    assert len(links) == 39 and len(set(root)) == 1
    # Nothing is compared that is one component already, or in another band.
    assert jaccard._forest([(*r[:2], 0, *r[3:]) for r in rows], 21) == [] == jaccard._forest(rows, 22)


def test_many_near_misses(table, monkeypatch):
    """Texts around the limit, of which hubs link few; sets are dropped and made again."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "HELD", 300)
    rng = random.Random(6)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(40):
            copy = list(base)
            for k in range(0, 150, 25):
                copy[k + rng.randrange(4) * (i % 3 + 1)] = f"x{rng.randrange(3)}"
            rows.append((len(rows), " ".join(copy)))
    check(table, rows)


def test_prefixes_are_not_moved_to_find_classes(table, monkeypatch):
    """Entries are dealt out as they are read; copies that several tasks give count once."""
    plans, cut = [], Tables.cut

    def noted(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(self, df)

    monkeypatch.setattr(Tables, "cut", noted)
    text = lambda k, n: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(100 * k + i, text(k, 60) + (" tail" if i % 4 == 3 else "")) for k in range(6) for i in range(12)] + [(None, text(1, 60)), (7, text(9, 3)), (8, "")]
    df = table(rows, "doc_id long, text string").repartition(7)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_groups(df).collect())
    assert got == plain(rows)
    below = [p.split("posexplode")[1] for p in plans if "posexplode" in p]
    assert len(below) == 1 and "Join" not in below[0]


def test_classes_of_one_code(table, monkeypatch):
    """Two texts with one code are compared although no entry of theirs is seen as shared."""
    monkeypatch.setattr(jaccard, "CODE", 1)
    texts = [" ".join(f"w{i}" for i in range(150)) + tail for tail in ("", " x", " y")]
    code = F.shiftrightunsigned(F.xxhash64("cls"), 63).alias("code")
    classes = table([(i, bytearray(jaccard.class_of(jaccard.shingles(t.encode())))) for i, t in enumerate(texts)], "i long, cls binary")
    codes = {}
    for r in classes.select("i", code).collect():
        codes.setdefault(r.code, []).append((r.i, texts[r.i]))
    rows = max(codes.values(), key=len)
    assert len(rows) > 1
    check(table, rows)


def test_given_classes():
    given = set()
    assert jaccard._not_given([b"a", None, b"b", b"a"], given) == [True, False, True, False]
    assert jaccard._not_given([b"b", b"c"], given) == [False, True]


def test_what_a_task_remembers_is_bounded(monkeypatch):
    monkeypatch.setattr(jaccard, "GIVEN", 2)
    given = set()
    assert jaccard._not_given([b"a", b"b", b"a", b"c", b"a", b"c"], given) == [True, True, False, True, True, False]
    assert len(given) == 2


def test_members_without_a_partner_stay_out(table):
    """Of the members of a tile only those go on that sizes, bands and early entries leave a partner, and all of those."""
    rng = random.Random(12)
    rows, wanted = [], set()
    for key in range(300):
        tile = [(key, c, n, int(n >= 100), rng.random() < 0.5) for c, n in enumerate(rng.choices(range(80, 125), k=rng.choice([2, 2, 3, 5])))]
        rows += tile
        for i, (_, u, a, p, x) in enumerate(tile):
            for _, v, b, q, y in tile[:i]:
                if 4 * max(a, b) <= 5 * min(a, b) and (x or a > b) and (y or b > a):
                    wanted |= {(key, max(p, q), u), (key, max(p, q), v)}
    df = table(rows, "key long, cls long, n long, band long, early boolean").withColumn("top", F.explode(F.array("band", F.col("band") + 1)))
    got = {(r.key, r.top, r.cls) for r in jaccard._with_partner(df).collect()}
    assert wanted <= got
    pairs = {k for k in range(300) if sum(r[0] == k for r in rows) == 2 and len({r[2] for r in rows if r[0] == k}) == 2}
    assert pairs and {x for x in got if x[0] in pairs} == {x for x in wanted if x[0] in pairs}
