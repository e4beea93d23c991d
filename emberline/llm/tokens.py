"""Token counts of byte-level BPE vocabularies by dynamic programming over prefixes.

A sequence of tokens is the encoding of its bytes exactly when each token encodes to
itself and each neighbouring pair encodes to that pair. So the last token of a prefix is
the one vocabulary entry that ends there and makes a valid pair with the last token of
the prefix before it, and the count of every prefix follows from a shorter prefix by
adding one. Nothing is merged again to truncate a text or to answer a budget.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from emberline.llm.common import as_bytes, narrow, record_batch

#: Splits of byte-level BPE (fixed value); white space in the sense of the Unicode property.
SPLITS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words whose counts a Python worker remembers (the first it meets, so the common ones are
#: among them), the longest of them, and pairs of tokens it remembers.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 1_000_000, 48, 500_000
LIMIT = 512


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts at every prefix, for a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in set(self.specials)}
        self.longest = max(map(len, self.vocab))
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self.pieces = regex.compile(SPLITS)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.loose = regex.compile(r" (?:\p{White_Space}|\Z)")
        self.known: dict[str, int] = {}
        self.before: tuple[bytes, list[int], list[bytes]] = (b"", [0], [b""])
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Encoding by merges in order of rank; used for single pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        """``right`` may follow ``left`` (empty: may start a piece)."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Token counts of all prefixes of one piece, the empty one included. What the piece
        has in common with the one before, so in sorted order most of it, is taken over."""
        known, count, last = self.before
        same = 0
        for x, y in zip(known, data, strict=False):
            if x != y:
                break
            same += 1
        count, last = count[: same + 1], last[: same + 1]
        vocab, fits, pairs, longest = self.vocab, self.fits, self.pairs, self.longest
        for end in range(same + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token in vocab:
                    fit = pairs.get((last[start], token))
                    if fit or fit is None and fits(last[start], token):
                        break
            count.append(count[start] + 1)
            last.append(token)
        self.before = data, count, last
        return count

    def size(self, piece: str) -> int:
        return self.piece(piece.encode())[-1]

    def split(self, text: str) -> list[str]:
        """Pieces in order; special strings are pieces of their own and one token each."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.pieces.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pieces.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.pieces.findall(text[at:])

    def sizes(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece of a split text."""
        special = set(self.specials)
        return [1 if p in special else self.size(p) for p in pieces]

    def total(self, text: str) -> int:
        return self.totals([text])[0]

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Where single spaces stand between words, a piece never
        reaches over a space, so what follows one is counted once and remembered."""
        parts = [self.words(t) for t in texts]
        new = {w for words in parts if words for w in words if w not in self.known}
        fresh = {w: sum(self.sizes(self.pieces.findall(w))) for w in sorted(new)}
        room = CACHE_WORDS - len(self.known)
        if room > 0:
            self.known.update((w, fresh[w]) for w in islice(fresh, room) if len(w) <= CACHE_CHARS)
        get, late = self.known.get, fresh.get
        out = []
        for text, words in zip(texts, parts, strict=True):
            if words is None:
                out.append(sum(self.sizes(self.split(text))))
                continue
            sizes = list(map(get, words))
            out.append(sum(sizes) if None not in sizes else sum(late(w) if n is None else n for w, n in zip(words, sizes, strict=True)))
        return out

    def words(self, text: str) -> list[str] | None:
        """The text cut before each space, or None if that could cut a piece in two."""
        if self.loose.search(text) or any(s in text for s in self.specials):
            return None
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + w for w in rest]

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens. Only a head of the
        text that surely holds it is split, twice as long until it holds enough tokens."""
        chars = 8 * limit + 64
        while True:
            head = PrefixIndex(self, text[:chars])
            if chars >= len(text) or head.counts[-1] > limit + 8 and head.counts[-2] > limit + 8:
                return head.truncate(limit)
            chars *= 2


class PrefixIndex:
    """Counts at the piece ends of one text; any prefix is answered from the nearest one."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        pieces = counter.split(text)
        self.ends = [0, *accumulate(map(len, pieces))]
        self.counts = [0, *accumulate(counter.sizes(pieces))]

    def at(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters. Cutting a text can only change the piece
        that is cut and white space before it, so the rest is taken from the table."""
        i = bisect_right(self.ends, chars) - 1
        if chars >= len(self.text):
            return self.counts[-1]
        while i and (self.ends[i] == chars or self.text[self.ends[i] - 1].isspace()):
            i -= 1
        # A special string that is cut is plain text, which may join the piece before it.
        while i and any(self.text.startswith(s, self.ends[i]) for s in self.counter.specials):
            i -= 1
        return self.counts[i] + self.counter.total(self.text[self.ends[i] : chars])

    def truncate(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        if self.counts[-1] <= budget:
            return len(self.text)
        # No count of a prefix is under that of an earlier piece end by more than the last two pieces.
        i = bisect_right(self.counts, budget + 2)
        for chars in range(self.ends[min(i + 1, len(self.ends) - 1)], 0, -1):
            if self.at(chars) <= budget:
                return chars
        return 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One table per Python worker and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, fit: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row's whole ``text``.

    ``vocabulary`` is a byte-level BPE file of the tokenizers library, present at that path
    on every machine. With ``fit`` also ``fit_chars``, the length of the longest prefix with
    at most ``limit`` tokens. Special strings in a text are one token each, as that library
    has it by default. A null text is empty; repeated and null ids give a row each; other
    columns are ignored. Map only: no shuffle, and a worker holds one batch, the vocabulary
    and a bounded table of words.
    """
    kind = dict(docs.dtypes)["doc_id"]
    fields = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())]
    out = pa.schema(fields if fit else fields[:3])

    def run(batches):
        prefix = counter(vocabulary)
        for batch in batches:
            data = [x or b"" for x in as_bytes(batch.column(1))]
            texts = [x.decode() for x in data]
            totals = prefix.totals(texts)
            columns = [[len(x) for x in data], totals, [n > limit for n in totals]]
            if fit:
                columns.append([len(t) if n <= limit else prefix.fitting(t, limit) for t, n in zip(texts, totals, strict=True)])
            rest = record_batch(out, *columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest.columns], names=["doc_id", *out.names])

    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", fit_chars long" * fit
    return narrow(docs, "doc_id", "text").mapInArrow(run, schema)
