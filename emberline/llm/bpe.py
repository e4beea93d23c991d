"""Byte-level BPE over a rank file: texts to token ids and back.

The bytes of a text stand as Latin-1 characters, so that an Aho-Corasick automaton over
characters holds the vocabulary. A run of tokens is the result of the merges exactly when
every two neighbours are left apart by the merges of those two alone. So a piece is cut into
longest matches; if all neighbours agree, that is its encoding. If not, the cut is redone
from left to right: a token that disagrees with the one before gives way to the next shorter
match, a place where no match is left is marked dead, and the token before it gives way in
turn. A place dies once, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import re
from itertools import islice, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberline.llm.common import as_bytes, narrow

#: Pieces whose ids a Python worker remembers (the first it meets), the longest of them, and
#: the pairs of tokens it remembers. Forgetting costs time only.
CACHE_PIECES, CACHE_CHARS, CACHE_PAIRS = 400_000, 32, 1_000_000
#: What ids are packed to: unsigned, 32 bits, little-endian.
PACKED = np.dtype("<u4")


def unicode_space(pattern: str) -> str:
    """The pattern with white space in the sense of the Unicode property."""
    return re.sub(r"\\([sS])", lambda m: r"\p{White_Space}" if m[1] == "s" else r"\P{White_Space}", pattern)


def read_ranks(path: str) -> dict[int, bytes]:
    """The tokens of a rank file: base64 bytes and rank, a token a line."""
    with open(path, "rb") as file:
        lines = [line.split() for line in file if line.strip()]
    return {int(rank): base64.b64decode(token) for token, rank in lines}


def decoded(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    """The bytes that packed ids stand for. An id that the vocabulary doesn't have is an error."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, PACKED).tolist()))


class Vocabulary:
    """Tokens of a rank file and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        #: Bytes as Latin-1 text, by rank and back.
        self.text = {rank: token.decode("latin-1") for rank, token in read_ranks(path).items()}
        self.ranks = {token: rank for rank, token in self.text.items()}
        missing = [b for b in range(256) if chr(b) not in self.ranks]
        if missing:
            raise ValueError(f"no token for byte {missing[0]}; a byte-level vocabulary has all 256")
        self.pieces = regex.compile(unicode_space(pattern))
        self.longest = max(map(len, self.ranks))
        #: The two tokens that the last merge of a token joins, for those that merges make.
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            parts = self.merged(token, stop=2)
            if len(token) > 1 and len(parts) == 2 and token not in parts:
                self.halves[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
            if len(token) == 1 or rank in self.halves:
                self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        # Halves that rank after their whole would let merges happen out of rank order.
        self.ordered = all(max(self.made(a), self.made(b)) < rank for rank, (a, b) in self.halves.items())
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, data: str, stop: int = 1) -> list[str]:
        """The parts of ``data`` after its merges in order of rank, the leftmost first, down to ``stop`` parts."""
        parts, rank = list(data), self.ranks.get
        while len(parts) > stop:
            low, at = min((rank(a + b, 1 << 60), i) for i, (a, b) in enumerate(pairwise(parts)))
            if low == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def made(self, token: int) -> int:
        """When merges make this token; single bytes are there from the start."""
        return token if token in self.halves else -1

    def apart(self, left: int, right: int) -> bool:
        """Do the merges of the two tokens' bytes end at these two? The merges that made them are
        undone, the latest first; a merge across the border that ranks before the one undone
        would have come first."""
        if not self.ordered:
            a, b = self.text[left], self.text[right]
            return self.merged(a + b) == [a, b]
        ranks, text, halves, made = self.ranks, self.text, self.halves, self.made
        limit = 1 << 60
        while True:
            if ranks.get(text[left] + text[right], 1 << 60) < limit:
                return False
            if made(left) > made(right):
                limit, left = left, halves[left][1]
            elif made(right) >= 0:
                # Of equal ranks the one further left, so the one across the border, comes first.
                limit, right = right + 1, halves[right][0]
            else:
                return True

    def agree(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.apart(left, right)
        return known

    def next_shorter(self, token: int) -> int | None:
        """The longest token that begins this one and isn't it."""
        if token not in self.shorter:
            text, found = self.text[token], None
            for end in range(len(text) - 1, 0, -1):
                rank = self.ranks.get(text[:end])
                if rank is not None and (end == 1 or rank in self.halves):
                    found = rank
                    break
            self.shorter[token] = found
        return self.shorter[token]

    def ids(self, piece: str) -> list[int]:
        """Tokens of one piece, its bytes as Latin-1."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        tokens = [rank for _, rank in self.automaton.iter_long(piece)]
        pairs, agree = self.pairs, self.agree
        for pair in pairwise(tokens):
            if not (pairs.get(pair) or agree(*pair)):
                return self.backtracked(piece)
        return tokens

    def backtracked(self, piece: str) -> list[int]:
        """The same, from left to right, going back where the longest match can't stay."""
        text, n, dead = self.text, len(piece), bytearray(len(piece) + 1)
        # A slice, as the automaton copies what it is given.
        longest = lambda at: next(self.automaton.iter_long(piece[at : at + self.longest]))[1]
        out, at, token = [], 0, longest(0)
        while True:
            end = at + len(text[token])
            if not dead[end] and (not out or self.agree(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest(at)
                continue
            token = self.next_shorter(token)
            while token is None:
                dead[at] = 1
                last = out.pop()
                at -= len(text[last])
                token = self.next_shorter(last)

    def packed(self, piece: str) -> bytes:
        return np.array(self.ids(piece.encode().decode("latin-1")), PACKED).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; what a piece stands for is worked out once for all of them."""
        cut = [self.pieces.findall(text) for text in texts]
        known = self.known
        fresh = {p: self.packed(p) for p in {p for pieces in cut for p in pieces if p not in known}}
        out = [b"".join([known.get(p) or fresh[p] for p in pieces]) for pieces in cut]
        short = (p for p in fresh if len(p) <= CACHE_CHARS)
        known.update((p, fresh[p]) for p in islice(short, max(0, CACHE_PIECES - len(known))))
        return out


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}
_TOKENS: dict[str, dict[int, bytes]] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per Python worker and file."""
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = Vocabulary(path, pattern)
    return _VOCABULARIES[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, packed: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row's whole ``text``.

    ``ids`` is an array of integers, or with ``packed`` their little-endian unsigned 32-bit form.
    ``path`` is a rank file, present on every machine; the matches of ``pattern`` are encoded
    one by one, without special tokens. A null or empty text has no tokens. Repeated rows and
    missing ids give a row each; other columns are not read. Map only: a worker holds a batch,
    the vocabulary and bounded tables of pieces and pairs.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            tool = vocabulary(path, pattern)
            found = tool.encode([(x or b"").decode() for x in as_bytes(batch.column(1))])
            counts = pa.array([len(x) // 4 for x in found], pa.int64())
            if packed:
                ids = pa.array(found, pa.binary())
            else:
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                flat = np.frombuffer(b"".join(found), PACKED).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, ids], names=["doc_id", "n_tokens", "ids"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded`` (binary) for their ``ids``, packed or as an array; null for null.

    Bytes, because ids need not end where a character does. An id outside the vocabulary ends
    the job with a KeyError that names it. A column ``decoded`` of the input is replaced.
    """
    rows = tokens.drop("decoded")
    packed = dict(rows.dtypes)["ids"] == "binary"
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = rows.columns.index("ids")

    def run(batches):
        for batch in batches:
            if path not in _TOKENS:
                _TOKENS[path] = read_ranks(path)
            ids = batch.column(at).to_pylist()
            data = ids if packed else [x if x is None else np.array(x, PACKED).tobytes() for x in ids]
            found = pa.array([x if x is None else decoded(x, _TOKENS[path]) for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)
