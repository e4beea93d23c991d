"""Quality rules: repetition inside a document, and lines that many documents of a host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import WORD, as_bytes, narrow, record_batch, word_hashes

#: A line is boilerplate if at least this many documents of its host have it, and more than this
#: share of them; a document is depleted if it keeps less than the last share of its words.
MIN_DOCUMENTS, MAX_SHARE, MIN_KEPT = 5, 0.05, 0.5
WINDOW = 5


def repeated_words(words: list[bytes]) -> int:
    """Words inside runs of five that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = word_hashes(words)
    _, number = np.unique(h, return_inverse=True)
    runs = np.stack([number[k : k + n] for k in range(WINDOW)], 1)
    _, which, count = np.unique(runs, axis=0, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which.ravel()] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def base_metrics(data: bytes | None) -> tuple:
    text = data or b""
    words = text.split()
    chars = len(b"".join(words).decode())
    lines = [x for x in text.split(b"\n") if x.split()]
    again = repeated_words(words)
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    return len(words), chars, sum(map(text.count, (bytes([c]) for c in b"#*$%&|<>"))), len(lines) - len(set(lines)), again, failed


def document_metrics(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id``, the carried columns and the measures that need one document only; map only, one
    row per row, repeated rows included. Null and empty texts have no words and fail."""
    kept = narrow(docs, "doc_id", *carried, "text")
    out = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows = [base_metrics(x) for x in as_bytes(batch.column("text"))]
            rest = record_batch(out, *(zip(*rows, strict=True) if rows else [[]] * 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *rest.columns], names=[*batch.schema.names[:-1], *out.names])

    types = "".join(f"{c} {t}, " for c, t in kept.dtypes[:-1])
    return kept.mapInArrow(
        run, types + "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    )


def identity() -> list:
    """``host, content``: a null source is a host; rows of one text on one host are one document."""
    return [F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content")]


def normal(line):
    """Lower-cased, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def common_lines(docs: DataFrame, min_documents=MIN_DOCUMENTS, max_share=MAX_SHARE) -> DataFrame:
    """``host, content, line, words, common``: the normalised lines (as hashes) of each document,
    the words on them over all its copies, and whether the line is boilerplate on its host.

    Counts are over distinct texts, so that copies of a document don't make its lines boilerplate,
    and rows without an id or with the same id need no rule of their own. Everything is
    pre-aggregated before it is shuffled; a line of every document is one row per document there,
    and adaptive execution splits it in the join.
    """
    lines = (
        narrow(docs, "source", "text").select(*identity(), F.explode(F.split("text", "\n")).alias("line"))
        .filter(F.col("line").rlike(WORD))
        .select("host", "content", normal("line").alias("line"))
        .groupBy("host", "content", F.xxhash64("line").alias("line"))
        .agg(F.sum(F.regexp_count("line", F.lit(WORD))).alias("words"))
    )
    hosts = narrow(docs, "source", "text").select(*identity()).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    # Counting the column `words` (never null) lets both uses of `lines` share one exchange.
    common = (
        lines.groupBy("host", "line").agg(F.count("words").alias("n"))
        .filter(F.col("n") >= min_documents).join(hosts, "host").filter(F.col("n") > max_share * F.col("documents"))
        .select("host", "line", F.lit(True).alias("common"))
    )
    return lines.join(common, ["host", "line"], "left").select(
        "host", "content", "line", "words", F.coalesce("common", F.lit(False)).alias("common"))


def losses(marked: DataFrame, min_kept=MIN_KEPT) -> DataFrame:
    """``host, content, removed, words, depleted, gone`` of documents with boilerplate: words on such
    lines and all words, both over all copies, whether too few stay, and the hashes of its lines that go."""
    gone = F.collect_list(F.when(F.col("common"), F.col("line"))).alias("gone")
    return (
        marked.groupBy("host", "content")
        .agg(F.sum(F.when(F.col("common"), F.col("words")).otherwise(0)).alias("removed"), F.sum("words").alias("words"), gone)
        .filter("removed > 0")
        .withColumn("depleted", F.col("words") - F.col("removed") < min_kept * F.col("words"))
    )


def without_common_lines(docs: DataFrame, min_kept=MIN_KEPT, **limits) -> DataFrame:
    """The rows of ``docs`` with all their columns, boilerplate lines cut out of ``text``; rows that
    lose too many words go. Null and empty texts, and texts without such lines, stay as they are;
    repeated rows are treated alike, and other columns may have any name."""
    lost = losses(common_lines(docs, **limits), min_kept).select("host", "content", "gone", "depleted")
    rows = docs.select(F.struct("*").alias("row"), *identity()).join(lost, ["host", "content"], "left")
    left = F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normal(x))))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return rows.filter("depleted IS NULL OR NOT depleted").select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def quality_rules(docs: DataFrame, min_kept=MIN_KEPT, **limits) -> DataFrame:
    """Measures and verdict for each row, and ``n_common_words``, its words on boilerplate lines. Null
    texts have no words and fail; equal rows are judged alike, rows without an id like all others."""
    lost = losses(common_lines(docs, **limits), min_kept).drop("gone").withColumnRenamed("words", "all_words")
    keyed = docs.select("doc_id", *identity(), "text")
    rows = document_metrics(keyed, "host", "content")
    # Both sums are over all copies of the text, so their ratio is that of one copy.
    common = F.coalesce(F.round(F.col("removed") * F.col("n_words") / F.col("all_words")), F.lit(0))
    return rows.join(lost, ["host", "content"], "left").select(
        *[c for c in rows.columns if c not in ("host", "content")], common.cast("long").alias("n_common_words"),
        (~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).alias("kept"))
