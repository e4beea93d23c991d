"""Personal data: fixed patterns, and a character tagger that adds what they miss.

The tagger is a bidirectional LSTM with CRF transitions, trained in numpy on made-up sentences with
labelled spans (patterns' own forms, spelt-out addresses, phones without a plus, dotted cards, and
numbers that are none of these). It reads overlapping windows over every stretch that can hold an
entity: an at sign, an ``(at)``, or four digits with gaps of at most three characters or of those of a
phone. Each character takes the tag of the window in which it is most central; where an edge of the
windows is tagged, more windows follow on that side until it is outside. Spans are made of the tags of the whole
text; a tagged address goes from its first character to its last.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.common import narrow, record_batch

KINDS = ("email", "ip", "card", "phone")
LENGTH, STRIDE, MARGIN, CHUNK = 64, 32, 16, 512
EMBED, HIDDEN, STEPS, BATCH, RATE = 10, 16, 220, 48, 0.02
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a start inside a run of digits finds no more than its first one
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
STRETCH = re.compile(r"[0-9](?:(?:[^0-9]{0,3}|[\x20()./-]+)[0-9]){3,}|@|[(\[]\s?at\s?[)\]]", re.IGNORECASE)
AT = re.compile(r"@|\s?[(\[]\s?at\s?[)\]]\s?", re.IGNORECASE)
LABELS = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[A-Za-z0-9-]+)+", re.IGNORECASE)
DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) < 4 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in LOCAL_SET:
            first -= 1
        found = DOMAIN.match(text, at) if first < at else None
        if found:
            end = found.end()
            out.append((first, 0, end))
        at = text.find("@", at + 1)
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if valid_ip(m.group())]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(n := digits(m.group())) <= 19 and luhn(n)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


# ---- labelled sentences ----------------------------------------------------------------------


def _entity(rng: random.Random) -> tuple[int, str]:
    name = lambda: "".join(rng.choice(["ra", "ten", "is", "lo", "mu", "ver", "ka", "din"]) for _ in range(rng.randint(1, 3)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.randrange(4)
    if kind == 0:
        at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] ")])
        return kind, f"{name()}{rng.choice(['', '.', '_'])}{name()}{at}{name()}{dot}{rng.choice(['com', 'org', 'net', 'example'])}"
    if kind == 1:
        return kind, ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        head = number(15)
        full = next(head + c for c in "0123456789" if luhn(head + c))
        return kind, rng.choice(["", " ", "-", "."]).join(full[i : i + 4] for i in range(0, 16, 4))
    return kind, rng.choice([f"+{number(2)} {number(3)} {number(7)}", f"+{number(1)}-{number(3)}-{number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"+{number(12)}"])


def _sentence(rng: random.Random) -> tuple[str, list[int]]:
    text, tags = "", []
    while len(text) < LENGTH + 40:
        roll = rng.random()
        if roll < 0.3:
            kind, piece = _entity(rng)
            tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
        else:
            if roll < 0.5:
                piece = rng.choice([str(rng.randrange(10**6)), f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
                                    f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(9)}", f"{rng.randrange(24)}:{rng.randrange(60):02}", f"${rng.randrange(99999)}.00",
                                    f"{rng.randrange(16**12):x}", f"{rng.randrange(10**16)}", "@", "###*** $$$"])
            else:
                piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCé") for _ in range(rng.randint(2, 9)))
            tags += [0] * len(piece)
        gap = rng.choice([" ", " ", " ", ", ", ".\n", ": "])
        text, tags = text + piece + gap, tags + [0] * len(gap)
    at = rng.randrange(40)
    return text[at : at + LENGTH], tags[at : at + LENGTH]


def _ids(text: str) -> np.ndarray:
    """Printable ASCII as it is, other white space, anything else, and 0 for no character."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 30, np.where(codes < 32, 1, 97))


# ---- the tagger ------------------------------------------------------------------------------


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lstm(x, w, u, b):
    """Hidden states of each step, and what the way back needs."""
    steps, n = x.shape[:2]
    h = c = np.zeros((n, HIDDEN), x.dtype)
    zx, hs, kept = x @ w + b, [], []
    for t in range(steps):
        z = zx[t] + h @ u
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, past = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs.append(h)
        kept.append((i, f, o, g, before, tc, past))
    return np.stack(hs), kept


def _lstm_back(dh_out, x, w, u, kept):
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), np.empty_like(x)
    dh = dc = np.zeros_like(kept[0][0])
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, g, before, tc, past = kept[t]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dw += x[t].T @ dz
        du += past.T @ dz
        db += dz.sum(0)
        dx[t], dh, dc = dz @ w.T, dz @ u.T, dc * f
    return dw, du, db, dx


def _logsum(a, axis):
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


class Tagger:
    def __init__(self, seed=3):
        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 0.25, s)
        gates = 4 * HIDDEN
        self.p = [make(98, EMBED), make(EMBED, gates), make(HIDDEN, gates), np.zeros(gates), make(EMBED, gates), make(HIDDEN, gates), np.zeros(gates),
                  make(2 * HIDDEN, TAGS), np.zeros(TAGS), make(TAGS, TAGS)]

    def emissions(self, ids):
        """Scores of tags; ``ids`` is steps by windows."""
        emb, wf, uf, bf, wb, ub, bb, out, bias, _ = self.p
        x = emb[ids]
        forth, kf = _lstm(x, wf, uf, bf)
        back, kb = _lstm(x[::-1], wb, ub, bb)
        h = np.concatenate([forth, back[::-1]], 2)
        return h @ out + bias, (x, h, kf, kb)

    def gradients(self, ids, tags):
        scores, (x, h, kf, kb) = self.emissions(ids)
        emb, wf, uf, _, wb, ub, _, out, _, trans = self.p
        steps, n = ids.shape
        alpha, beta = [scores[0]], [np.zeros((n, TAGS))]
        for t in range(1, steps):
            alpha.append(_logsum(alpha[-1][:, :, None] + trans, 1) + scores[t])
        for t in range(steps - 1, 0, -1):
            beta.insert(0, _logsum(trans + (scores[t] + beta[0])[:, None, :], 2))
        total = _logsum(alpha[-1], 1)
        d = np.exp(np.stack(alpha) + np.stack(beta) - total[:, None])
        d[np.arange(steps)[:, None], np.arange(n), tags] -= 1
        dtrans = np.zeros_like(trans)
        for t in range(1, steps):
            dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
            np.add.at(dtrans, (tags[t - 1], tags[t]), -1)
        d, dtrans = d / n, dtrans / n
        dh = d @ out.T
        gf = _lstm_back(dh[:, :, :HIDDEN], x, wf, uf, kf)
        gb = _lstm_back(dh[::-1, :, HIDDEN:], x[::-1], wb, ub, kb)
        demb = np.zeros_like(emb)
        np.add.at(demb, ids, gf[3] + gb[3][::-1])
        return [demb, *gf[:3], *gb[:3], np.einsum("tnh,tnk->hk", h, d), d.sum((0, 1)), dtrans]

    def train(self, seed=11):
        rng = random.Random(seed)
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for step in range(1, STEPS + 1):
            rows = [_sentence(rng) for _ in range(BATCH)]
            ids = np.stack([_ids(t) for t, _ in rows], 1)
            for i, g in enumerate(self.gradients(ids, np.array([k for _, k in rows]).T)):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                self.p[i] = self.p[i] - RATE * (1 - 0.8 * step / STEPS) * m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.p = [p.astype(np.float32) for p in self.p]
        return self

    def decode(self, ids):
        """Best tags of each window by Viterbi; steps by windows."""
        scores, _ = self.emissions(ids)
        trans, best, back = self.p[-1], scores[0], []
        for t in range(1, len(ids)):
            way = best[:, :, None] + trans
            back.append(way.argmax(1))
            best = way.max(1) + scores[t]
        tags = [best.argmax(1)]
        for step in reversed(back):
            tags.append(step[np.arange(ids.shape[1]), tags[-1]])
        return np.stack(tags[::-1])


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger().train()


def _windows(text: str) -> list[int]:
    """Starts of the windows over all stretches, with at least a margin on both sides."""
    starts, covered = [], 0
    for m in STRETCH.finditer(text):
        first, end = max(0, m.start() - MARGIN - STRIDE // 2), min(len(text), m.end() + MARGIN)
        while covered < end:
            at = max(first, covered - (LENGTH - STRIDE) if covered > first else first)
            starts.append(at)
            covered = at + LENGTH
    return starts


def _plausible(kind: int, text: str) -> bool:
    n = digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+(?:@|\s?[(\[]\s?at\s?[)\]]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[A-Za-z0-9-]+)+", text, re.IGNORECASE))
    if kind == 1:
        return bool(IP.fullmatch(text)) and valid_ip(text)
    if kind == 2:
        return 14 <= len(n) <= 19 and luhn(n) and len(text) <= len(n) + 6
    return 10 <= len(n) <= 15 and bool(re.fullmatch(r"\+?\(?[0-9][\x20().0-9/-]+[0-9]", text)) and bool(re.search(r"[+(]", text))


def _choose(text: str, starts: list[int], tags, chosen: dict[int, int], near: dict[int, int]) -> None:
    """The tags of these windows go to the characters that are more central here than before."""
    for at, row in zip(starts, tags, strict=True):
        for k in range(min(LENGTH, len(text) - at)):
            middle = min(k if at else LENGTH, LENGTH - 1 - k)
            if middle > near.get(at + k, -1):
                near[at + k], chosen[at + k] = middle, int(row[k])


def _further(text: str, starts: list[int], chosen: dict[int, int], many: int) -> list[int]:
    """Starts of ``many`` windows on each side where the covered text ends with a tag in its last margin."""
    more = set()
    for at in starts:
        if at and at - 1 not in chosen and any(chosen[p] for p in range(at, min(at + MARGIN, len(text)))):
            more.update(range(at - STRIDE, max(-STRIDE, at - STRIDE * (many + 1)), -STRIDE))
        end = at + LENGTH
        if end < len(text) and end not in chosen and any(chosen[p] for p in range(end - MARGIN, end)):
            more.update(range(at + STRIDE, min(len(text), at + STRIDE * (many + 1)), STRIDE))
    return sorted({max(0, x) for x in more})


def _spelt(text: str) -> list[tuple[int, int]]:
    """Bounds of the addresses with an at sign or a bracketed ``at``, leftmost and non-overlapping."""
    out, end = [], 0
    for m in AT.finditer(text):
        first = m.start()
        while first > end and text[first - 1] in LOCAL_SET:
            first -= 1
        found = LABELS.match(text, m.end()) if first < m.start() else None
        if found:
            end = found.end()
            out.append((first, end))
    return out


def _join(text: str, chosen: dict[int, int], base: list) -> list[tuple[int, int, int]]:
    """All spans of a text: the base ones, and the tagged ones that lie apart from them."""
    found, last, kind = [], -2, None
    for pos in sorted(p for p, tag in chosen.items() if tag):
        k, begins = (chosen[pos] - 1) // 2, chosen[pos] % 2 == 1
        if pos == last + 1 and k == kind and not begins:
            found[-1][2] = pos + 1
        else:
            found.append([pos, k, pos + 1])
        last, kind = pos, k
    bounds = _spelt(text) if any(k == 0 for _, k, _ in found) else []
    whole = {(s, k, e) for s, k, e in found if k}
    for s, _, e in (x for x in found if not x[1]):  # an address is tagged whole, wherever its tags begin and end
        whole |= {(a, 0, b) for a, b in bounds if a < e and b > s} or {(s, 0, e)}
    apart = lambda s, e: all(e <= a or s >= b for a, _, b in base)
    return sorted(base + [(s, k, e) for s, k, e in whole if _plausible(k, text[s:e]) and apart(s, e)])


def find_spans(texts: list[str | None], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; windows of all texts go through the tagger together."""
    texts = [t or "" for t in texts]
    base, starts = [base_spans(t) for t in texts], [_windows(t) for t in texts]
    chosen, near, todo, many = [{} for _ in texts], [{} for _ in texts], starts, 1
    while any(todo):
        rows = _tagged([t[a : a + LENGTH] for t, s in zip(texts, todo, strict=True) for a in s], model)
        for i, text in enumerate(texts):
            _choose(text, todo[i], islice(rows, len(todo[i])), chosen[i], near[i])
        todo = [_further(t, s, c, many) if s else s for t, s, c in zip(texts, todo, chosen, strict=True)]
        many *= 2
    return [(b, _join(t, c, b) if c else b) for t, b, c in zip(texts, base, chosen, strict=True)]


def _tagged(pieces: list[str], model: Tagger):
    """The tags of each window."""
    for i in range(0, len(pieces), CHUNK):
        ids = np.zeros((LENGTH, len(pieces[i : i + CHUNK])), np.int64)
        for k, piece in enumerate(pieces[i : i + CHUNK]):
            ids[: len(piece), k] = _ids(piece)
        yield from model.decode(ids).T


def _text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans`` for each row.

    The counts are those of the fixed patterns, ``n_added`` the spans of the tagger. Null texts are
    empty; repeated rows and null ids give a row each. Map only; the model is some thousand numbers.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(tagger())
    out = pa.schema([*[(f"n_{k}", pa.int64()) for k in KINDS], ("n_added", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            rows = [
                (*[sum(k == i for _, k, _ in base) for i in range(len(KINDS))], len(whole) - len(base), hashlib.sha256(_text(base).encode()).hexdigest(), _text(whole))
                for base, whole in find_spans(batch.column(1).to_pylist(), shared.value)
            ]
            rest = record_batch(out, *(zip(*rows, strict=True) if rows else [[]] * len(out)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest.columns], names=["doc_id", *out.names])

    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The rows with each span of ``text`` replaced by its kind, as ``<EMAIL>``; of overlapping
    spans the first decides and the stretch goes as one. Other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger())
    at = docs.columns.index("text")

    def cut_out(text, spans):
        if text is None:
            return None
        out, end = [], 0
        for s, k, e in spans:
            if s >= end:
                out += [text[end:s], f"<{KINDS[k].upper()}>"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches):
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            columns[at] = pa.array([cut_out(t, whole) for t, (_, whole) in zip(texts, find_spans(texts, shared.value), strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return narrow(docs, *docs.columns).mapInArrow(run, docs.schema)
