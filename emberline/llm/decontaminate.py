"""Benchmark passages in documents, found by a generalised suffix automaton.

All items, as word numbers, are put into one automaton. A document is streamed through it
once; the state's length is the longest run of words that ends here and stands in an item.
Only stretches of words that all occur in the benchmark are streamed, as any other word
takes the automaton back to its start.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import as_bytes, narrow, record_batch

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased UTF-8.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Words of all items together; the automaton has at most twice as many states.
MAX_BENCHMARK_WORDS = 2_000_000


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.ids = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        self.windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in WORDS.findall(text.lower())]
            width = min(window, len(words))
            for i in range(len(words) - width + 1 if width else 0):
                self.windows.setdefault(tuple(words[i : i + width]), set()).add(item)
            last = 0
            for w in words:
                last = self.extend(last, w)
        self.widths = sorted({len(w) for w in self.windows})

    def state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.len.append(length)
        return len(self.len) - 1

    def split(self, p: int, w: int) -> int:
        """The state of ``p`` followed by ``w``, made one of its own if longer runs share it."""
        q = self.next[p][w]
        if self.len[q] == self.len[p] + 1:
            return q
        own = self.state(self.len[p] + 1, q)
        self.link[q] = own
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = own
            p = self.link[p]
        return own

    def extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self.split(last, w)
        new, p = self.state(self.len[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = self.split(p, w) if p >= 0 else 0
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first, end) of the maximal hit stretches, and the items with windows in them."""
        if not self.widths:
            return [], set()
        numbers, spans, items = list(map(self.ids.get, words)), [], set()
        shortest, start = self.widths[0], 0
        while start < len(numbers):
            if numbers[start] is None:
                start += 1
                continue
            try:
                end = numbers.index(None, start)
            except ValueError:
                end = len(numbers)
            if end - start >= shortest:
                self.stream(numbers, start, end, spans, items)
            start = end
        return spans, items

    def stream(self, numbers, start, end, spans, items) -> None:
        state, length = 0, 0
        for i in range(start, end):
            w = numbers[i]
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            state = self.next[state].get(w, 0)
            length = length + 1 if state else 0
            for width in self.widths:
                if length < width:
                    break
                found = self.windows.get(tuple(numbers[i - width + 1 : i + 1]))
                if found:
                    items |= found
                    first = i - width + 1
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))


def automaton(benchmark: DataFrame, window: int = WINDOW) -> Automaton:
    """Of the whole benchmark, whose size is measured first; a larger one is refused."""
    n = benchmark.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F:-@\[-`{-\x7F]+")))).first()[0] or 0
    if n > MAX_BENCHMARK_WORDS:
        raise ValueError(f"{n} benchmark words; at most {MAX_BENCHMARK_WORDS} fit one automaton, so pass items in parts")
    rows = benchmark.select(F.col("item_id").cast("string"), "text").collect()
    return Automaton([(r[0], r[1].encode()) for r in rows if r[0] is not None and r[1]], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row.

    A word is hit inside any run of ``window`` words of an item, or inside a whole item that
    is shorter. Null texts and items have no words; items without an id are left out;
    repeated rows give a row each. Map only; the automaton goes to each task.
    """
    kind, found = dict(docs.dtypes)["doc_id"], automaton(benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    out = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = []
            for data in as_bytes(batch.column(1)):
                words = WORDS.findall((data or b"").lower())
                spans, items = shared.value.match(words)
                hit = sum(b - a for a, b in spans)
                digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                rows.append((len(words), hit, len(items), digest, hit > 0))
            rest = record_batch(out, *(zip(*rows, strict=True) if rows else [[]] * 5))
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest.columns], names=["doc_id", *out.names])

    return narrow(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """The rows with hit stretches cut out of ``text``; a row of which more than
    ``max_coverage`` of the words is hit goes. Other columns and clean rows stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(benchmark, window))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep, texts = [], []
            for data in as_bytes(batch.column(at)):
                marks = list(WORDS.finditer((data or b"").lower()))
                spans, _ = shared.value.match([m.group() for m in marks])
                keep.append(sum(b - a for a, b in spans) <= max_coverage * len(marks))
                for a, b in reversed(spans):
                    data = data[: marks[a].start()] + data[marks[b - 1].end() :]
                texts.append(None if data is None else data.decode())
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
