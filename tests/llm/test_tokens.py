"""Token counts against the library that owns the vocabulary."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberline.llm.tokens import PrefixCounter, PrefixIndex, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"ab th'sre  \n\t\u0085é漢字🙂123.,!?\x1c\x00", "<|endoftext|>", "  ", " the", "'re", " \n\n x"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_prefixes_and_budgets(library):
    counter, rng = PrefixCounter(PATH), random.Random(3)
    for _ in range(120):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20)))
        want = [library(text[:k]) for k in range(len(text) + 1)]
        index = PrefixIndex(counter, text)
        assert [index.at(k) for k in range(len(text) + 1)] == want
        for budget in (0, 2, 7):
            assert counter.fitting(text, budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_rows(spark, table, library):
    texts = [None, "", " ", "a b", "a b", "x" * 30_000, "word " * 900]
    df = table([(i, t, "extra") for i, t in enumerate(texts)] + [(None, "a", "b")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in token_counts(df, PATH, fit=True).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len(t or ""), library(t or ""))
        assert got[i].over_limit == (got[i].n_tokens > 512)
    assert got[None].n_tokens == 1 and len(got) == len(texts) + 1
    assert token_counts(df.limit(0), PATH).count() == 0


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: library(r.text or "") for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == want
