"""Benchmark hits and quality rules against brute force."""

import hashlib
import random
import re

from emberline.llm.decontaminate import contamination, remove_spans
from emberline.llm.lines import quality_rules, without_common_lines


def brute(text, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        k = min(width, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination(spark, table):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "c", "é", "d1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 6, 9, 10, 14])))) for i in range(12)] + [(99, None), (None, "a b")]
    items = [x for x in items if x[1] is None or len(x[1].split()) != 1]
    docs = [(i, "-".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(70, None), (71, ""), (None, items[2][1])]
    got = contamination(table(docs, "doc_id long, text string"), table(items, "item_id long, text string")).collect()
    known = [x for x in items if x[0] is not None]
    want = sorted(((i, *brute(t, known)) for i, t in docs), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_spans_are_cut(table):
    items = table([(1, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    docs = table([(1, "x " * 30 + " ".join(f"w{i}" for i in range(12)) + " end"), (2, "clean text"), (3, None), (4, " ".join(f"w{i}" for i in range(12)))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in remove_spans(docs, items).collect()}
    assert got == {1: "x " * 30 + " end", 2: "clean text", 3: None}


def test_quality_rules(table):
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    rows = [(i, "h", f"menu home {i % 2}\n{body(i)}") for i in range(6)] + [(10, "h", " ".join(["Share  THIS page with all of your friends now please"] * 1) + " ok"), (11, None, None), (12, "h", ""), (13, "g", "a b c d e f g h i j\na b c d e f g h i j")]
    rows += [(20 + i, "k", f"The same line of exactly ten words stands in here\nx{i}") for i in range(6)]
    got = {r.doc_id: r for r in quality_rules(table(rows, "doc_id long, source string, text string"), min_documents=3, max_share=0.5).collect()}
    assert all(got[i].kept for i in range(6)) and got[10].kept
    assert got[11].base_failed and got[12].base_failed and got[11].n_words == 0
    assert (got[13].n_dup_lines, got[13].n_repeat_words, got[13].base_failed) == (1, 20, True)
    assert not any(got[20 + i].kept for i in range(6)) and not got[20].base_failed


MENU = "Home  About us and our partners\tContact Imprint Privacy Terms and more"


def plain_lines(rows):
    """n_common_words, depleted and the text left of each row, with the production limits."""
    normal = lambda line: " ".join(line.lower().split())
    texts, count = {}, {}
    for _, host, text in rows:
        texts.setdefault(host, set()).add(text or "")
    for host, some in texts.items():
        for text in some:
            for line in {normal(x) for x in text.split("\n")} - {""}:
                count[host, line] = count.get((host, line), 0) + 1
    out = []
    for _, host, text in rows:
        common = [x for x in (text or "").split("\n") if count.get((host, normal(x)), 0) >= max(5, 0.05 * len(texts[host]) + 1e-9)]
        n, words = sum(len(x.split()) for x in common), len((text or "").split())
        out.append((n, words - n < 0.5 * words, text if not n else "\n".join(x for x in text.split("\n") if x not in common)))
    return out


def test_boilerplate_with_production_limits(table):
    rng = random.Random(8)
    body = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, "a", f"{MENU}\n{body(30)}\n\n{body(4)}") for i in range(40)]
    rows += [(100 + i, "a", f"{MENU.upper()}\n{MENU}\n{body(5)}") for i in range(8)]
    rows += [(None, "a", f"{MENU}\n{body(3)}"), (None, "a", f"{MENU}\n{body(25)}"), (7, "a", f"{MENU}\n{body(2)}"), (7, "a", rows[7][2])]
    rows += [(200 + i, "b", f"{MENU}\n{body(3)}") for i in range(4)] + [(300 + i, "b", body(12)) for i in range(10)]
    rows += [(400 + i, None, f"{MENU}\n{body(3)}") for i in range(5)] + [(500 + i, "c", f"{MENU}\nthe same page in every row of this host again") for i in range(30)]
    rows += [(600, "c", None), (601, "c", ""), (602, "c", " \n\t"), (603, "a", MENU + "\n" + body(60_000))]
    want = plain_lines(rows)
    docs = table([(*r, "x", 1, True) for r in rows], "doc_id long, source string, text string, host string, content int, common boolean")
    got = quality_rules(docs).collect()
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_common_words, r.kept) for r in got])) == sorted(
        str((i, len((t or "").split()), n, not lost and not base)) for (i, _, t), (n, lost, _), base in zip(rows, want, [failed(t) for _, _, t in rows], strict=True))
    assert sum(n > 0 and lost for n, lost, _ in want) >= 15 and any(n > 0 and not lost for n, lost, _ in want)
    left = without_common_lines(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, [tuple(r) for r in left.collect()])) == sorted(
        str((i, host, text, "x", 1, True)) for (i, host, _), (_, lost, text) in zip(rows, want, strict=True) if not lost)
    assert quality_rules(docs.limit(0)).count() == without_common_lines(docs.limit(0)).count() == 0


def failed(text):
    words = (text or "").split()
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for r in runs:
        seen[r] = seen.get(r, 0) + 1
    again = {i + k for i, r in enumerate(runs) if seen[r] > 1 for k in range(5)}
    return len(words) < 10 or 100 * len(again) > 20 * len(words)
