"""Ranked search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import pytest

from emberline.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, count=10):
    bags = [(i, Counter(w)) for i, text in docs if (w := fold(text))]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 100 - 90 + 90 * sum(bag.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in {*fold(text)} if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -score) for k, (score, none, doc) in enumerate(sorted(scored)[:count])]
    return sorted(map(str, out))


def check(table, docs, items):
    d = table([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, rank int")
    b = table([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = search.search(d, b)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    found = sorted(str(tuple(r)) for r in got.collect())
    assert found == plain(docs, items)
    return found


@pytest.fixture(params=["terms", "all"])
def small(request, monkeypatch):
    """Small blocks and steps; with the items' terms alone in the index, and with all."""
    monkeypatch.setattr(search, "BLOCK_DOCUMENTS", 16)
    monkeypatch.setattr(search, "ITEMS", 3)
    monkeypatch.setattr(search, "HELD", 2)
    monkeypatch.setattr(search, "FIRST", 4)
    if request.param == "all":
        monkeypatch.setattr(search.vocabulary, "__defaults__", (0,))


def test_documents(table, small):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i * 7 % 301, text(rng.randint(1, 60))) for i in range(150)]
    items = [(i, text(rng.choice([3, 12, 200]))) for i in range(12)]
    docs += [(500 + i, items[0][1]) for i in range(25)]  # more equal ones than places
    assert len(check(table, docs, items)) > 100


def test_odd_rows(table, small):
    long = "Very, very long text " * 20_000
    docs = [(1, None), (2, ""), (3, " ?!\n"), (4, "Été ÉTÉ été"), (5, "A a-b_c d 1"), (5, "A a-b_c d 1"), (None, "a b"), (None, "a b"), (6, long), (7, "漢字 text"), (8, "b b b b a")]
    items = [(1, "a b"), (1, "a b"), (None, "a TEXT"), (2, None), (3, ""), (4, "nothing-of-it"), (5, "été É"), (6, long), (7, "漢字"), (8, "c d")]
    check(table, docs, items)
    check(table, docs, [])
    check(table, [], items)
    check(table, docs[:3], items)


def test_many_terms_of_one_item(table, small):
    """More terms than a mask has bits."""
    rng = random.Random(2)
    words = [f"t{i}" for i in range(300)]
    check(table, [(i, " ".join(rng.sample(words, 40))) for i in range(80)], [(1, " ".join(words)), (2, " ".join(words[::2]))])


def test_few_documents_are_scored(monkeypatch):
    """Masks below the last place are never scored."""
    scored = []
    inner = search.Block.scores
    monkeypatch.setattr(search.Block, "scores", lambda self, held, places: scored.append(len(places)) or inner(self, held, places))
    rng, builder = random.Random(4), search.Builder(None)
    words = [f"w{i}" for i in range(500)]
    for i in range(3000):
        builder.add(i, " ".join(["the", "of", *rng.sample(words, 8)]).encode())
    for i in range(20):
        builder.add(5000 + i, " ".join([*words[:9], "the"]).encode())
    import pyarrow as pa

    names = ["documents", "words", "ids", "sizes", "terms", "counts", "positions", "frequencies"]
    row = dict(zip(names, builder.row(pa.int64()), strict=True))
    block = search.Block(row, 3020, builder.total)
    found = block.search([(w.encode(), 5000) for w in words[:9]] + [(b"the", 10)], 10, 0)
    assert [block.ids[p] for _, p in found] == list(range(5000, 5010))
    assert sum(scored) < 300
