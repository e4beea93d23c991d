"""Repeated byte strings against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from emberline.llm import repeats


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((str(doc_id), len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(table, rows):
    df = table([(a, b, 1) for a, b in rows], "doc_id long, text string, uid long")
    got = sorted((str(r.doc_id), *r[1:]) for r in repeats.repeat_report(df).collect())
    assert got == plain(rows, repeats.LENGTH)


def corpus():
    rng = random.Random(11)
    letters = "abcdefgh é\n"

    def noise(n):
        return "".join(rng.choices(letters, k=n))

    passages = [noise(n) for n in (199, 200, 201, 320, 900)]
    texts = [None, "", "short", "a" * 900, "ab" * 400, noise(150) * 5, noise(3000), noise(3000)]
    for i in range(60):
        parts = [noise(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 3)
            parts += [p[cut:] if i % 3 else p, noise(rng.randint(0, 80))]
        texts.append("".join(parts))
    texts += [texts[10]] * 3 + [texts[11][:-1] + "!", texts[6][:1500] + "?" + texts[6][1500:]]
    return [(None if i == 5 else i % 40, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("crowd", [512, 2])
def test_repeats(table, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "MAX_CLASSES", crowd)
    check(table, corpus())


def test_no_rows(table):
    check(table, [])
    check(table, [(1, None)])


def test_small_steps_and_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 50)
    a = np.random.default_rng(3).integers(97, 100, 700).astype(np.uint8)
    starts = [first + k for _, _, firsts, ns in repeats.stretches(a, 40, 9) for first, n in zip(firsts, ns, strict=True) for k in range(n)]
    assert starts == list(range(661))


@pytest.mark.parametrize("length", [8, 13, 40])
def test_intervals_against_counts(length):
    rng = random.Random(length)
    for _ in range(30):
        base = bytes(rng.choices(b"abc", k=rng.randint(length, 300)))
        texts = [bytes(rng.choices(b"abc", k=rng.randint(length, 60))) + base[rng.randrange(9) :] for _ in range(rng.randint(1, 6))]
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t, runs in zip(texts, repeats._block(texts, length), strict=True):
            starts = {i for a, b in zip(runs[::2], runs[1::2], strict=True) for i in range(a, b)}
            assert starts == {i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1}


def test_equal_strings_have_equal_cores():
    """Parts under a crowded anchor meet by core, so no two equal strings may be in parts of different cores."""
    rng = random.Random(5)
    length, gram = 60, 12
    anchor = bytes(rng.choices(b"abcdef", k=gram))
    sides = [(bytes(rng.choices(b"uvw", k=48)), bytes(rng.choices(b"xyz", k=48))) for _ in range(3)]
    for _ in range(60):
        seen = {}
        for n, (left, right) in enumerate(rng.choices(sides, k=4)):
            text = left[rng.randrange(20) :] + anchor + right[: rng.randrange(30, 49)]
            for found in repeats.stretches(np.frombuffer(text, np.uint8), length, gram):
                for key, _, first, count in zip(*found, strict=True):
                    piece = text[first : first + count + length - 1]
                    for p in repeats._parts(piece, int(count), length, gram):
                        for k in range(len(p["strings"])):
                            at = p["first"] + k
                            seen.setdefault((key, piece[at : at + length]), set()).add(p["core"])
        assert all(len(cores) == 1 for cores in seen.values())
        assert len(set().union(*seen.values())) > 1
