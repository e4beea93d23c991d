"""Base spans against plain patterns; the tagger's spans on sentences it has not seen."""

import hashlib
import random
import re

from emberline.llm import pii


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_patterns():
    rng = random.Random(2)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4.5", "256.1.1.1", "10.0.0.255", "4432507579035540", "4111 1111 1111 1111", "+49 30 1234567", "+1(2)", ".", " ", "7", "é", "b@c.d@e.f", "-", "००"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_tagger():
    rng, right, total, wrong = random.Random(99), 0, 0, 0
    for _ in range(300):
        kind, piece = pii._entity(rng)
        text = f"Lorem dita su {piece}, vento kal 2024-03-05 ma 12.5 ena."
        (_, spans), = pii.find_spans([text], pii.tagger())
        right += (14, kind, 14 + len(piece)) in spans
        wrong += len([s for s in spans if s[0] != 14])
        total += 1
    assert right >= 0.9 * total and wrong <= 0.02 * total, (right, wrong, total)


def test_rows(table):
    long = "word " * 30000 + "me@here.org" + " 1" * 20000
    rows = [(1, "call +49 30 1234567 or a@b.co", 1), (1, "call +49 30 1234567 or a@b.co", 1), (None, None, 2), (3, "", 3), (4, long, 4)]
    df = table(rows, "doc_id long, text string, spans int")
    got = pii.personal_data(df).collect()
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        digest = hashlib.sha256(pii._text(plain(text)).encode()).hexdigest()
        assert r.base_sha256 == digest and r.n_email + r.n_ip + r.n_card + r.n_phone == len(plain(text))
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[1] == "call <PHONE> or <EMAIL>" and red[None] is None and "<EMAIL>" in red[4]
    assert pii.redact(df.limit(0)).count() == 0


def test_long_addresses_are_whole():
    """Entities longer than a window's margin, and bracketed words in capitals, up to their last character."""
    tail = " in dita su vento kal ma ena. " * 4
    for piece in ["j.doe (at) physics-department [dot] university [dot] example", "j.doe (at) computational-linguistics [dot] example",
                  "marisveraten.kadinloverismu.tenkaraisdinlo.mu (at) kara.example", "mura.tenlo (AT) verka.example", "mura.tenlo [At] verka [DOT] example"]:
        text = tail + piece + tail
        (_, spans), = pii.find_spans([text], pii.tagger())
        assert (len(tail), 0, len(tail) + len(piece)) in spans, (piece, [text[s:e] for s, _, e in spans])
