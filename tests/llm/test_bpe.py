"""Ids and bytes against the library that owns the rank files."""

import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.errors import PythonException

from emberline.llm import bpe

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
PARTS = [*"ab th'sre  \n\t\u0085  é漢字🙂123.,!?\x1c\x00", "<|endoftext|>", "  ", " the", "'re", " \n\n x", "aaaa", "ingtion", "ééé", "=-=-", "ерное"]


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return bpe.Vocabulary(path, public_tokenizers.PATTERN), library(path)


def test_made_up_texts(pair):
    own, other = pair
    tokens = {r: t.encode("latin-1") for t, r in own.ranks.items()}
    rng = random.Random(8)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(97, 122), rng.randint(0xE0, 0x17F), rng.randint(0x400, 0x4FF)])) for _ in range(60)) for _ in range(500)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == other.encode_ordinary(text), text
        assert bpe.decoded(ids, tokens) == text.encode()


def test_pairs_and_pieces_against_merges(pair):
    """Walking back through the merges tells the same as merging, and so does going back in a piece."""
    own, _ = pair
    rng = random.Random(5)
    tokens = [t for t in own.ranks if len(t) == 1 or own.ranks[t] in own.halves]
    seen = set()
    for _ in range(20000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if rng.random() < 0.7:
            cut = rng.randint(1, len(a))
            a, b = (a[:cut], a[cut:] + b[: rng.randint(0, 3)]) if a[:cut] in own.ranks and a[cut:] + b[:0] in own.ranks else (a, b)
        if b not in own.ranks or own.ranks[a] >= 256 and own.ranks[a] not in own.halves or own.ranks[b] >= 256 and own.ranks[b] not in own.halves:
            continue
        want = own.merged(a + b) == [a, b]
        seen.add(want)
        assert own.apart(own.ranks[a], own.ranks[b]) == want, (a, b)
    assert seen == {True, False}
    for _ in range(2000):
        piece = "".join(rng.choice(tokens) for _ in range(rng.randint(2, 6)))
        assert [own.text[i] for i in own.backtracked(piece)] == own.merged(piece)


def test_time_is_linear(pair):
    own, other = pair
    took = []
    for n in (20_000, 80_000):
        for unit in ("a", "ab", "abcabcab"):
            piece = (unit * n)[:n]
            began = time.process_time()
            ids = own.backtracked(piece)
            took.append(time.process_time() - began)
            if n == 20_000:
                assert ids == other.encode_ordinary(piece)
    assert sum(took[3:]) < 10 * sum(took[:3]) + 0.5


def test_rank_file_without_a_byte(tmp_path):
    file = tmp_path / "short"
    file.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(255)))
    with pytest.raises(ValueError, match="255"):
        bpe.Vocabulary(str(file), ".")


def test_halves_that_rank_late(tmp_path):
    """Vocabularies whose merges aren't in rank order, or that hold tokens no merge makes."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cd", b"xyz", b"bcd", b"abcd"]
    file = tmp_path / "odd"
    file.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own, other, rng = bpe.Vocabulary(str(file), public_tokenizers.PATTERN), library(str(file)), random.Random(1)
    assert not own.ordered
    for text in ["xyz", "xyzz", *("".join(rng.choices("abcdxyz", k=9)) for _ in range(2000))]:
        assert own.ids(text) == other.encode_ordinary(text), text


def test_rows(table):
    path, pattern = public_tokenizers.path(FILES[1]), public_tokenizers.PATTERN
    other = library(path)
    texts = [None, "", " ", "a b", "a b", "x" * 30_000, "word  " * 9000, "漢字" * 2000]
    df = table([(i, t, "extra", 7) for i, t in enumerate(texts)] + [(None, "a", "b", 7), (3, "again", "b", 7)], "doc_id long, text string, ids string, n_tokens int")
    for packed in (False, True):
        rows = bpe.decode(bpe.encode(df, path, pattern, packed), path).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            text = r.decoded.decode()
            assert text in ({texts[r.doc_id] or "", "again"} if r.doc_id is not None else {"a"})
            ids = list(memoryview(bytes(r.ids)).cast("I")) if packed else r.ids
            assert ids == other.encode_ordinary(text) and r.n_tokens == len(ids)
    assert bpe.encode(df.limit(0), path, pattern).count() == 0
    odd = table([(1, [50_000], "x"), (2, None, "y"), (3, [], "z")], "doc_id long, ids array<int>, decoded string")
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in bpe.decode(odd, path).collect()}.keys() == {1, 2, 3}
    with pytest.raises(PythonException, match="KeyError: 60000"):
        bpe.decode(table([(1, [60_000])], "doc_id long, ids array<int>"), path).collect()


def test_query(spark, sf_dir):
    """The registered query, row by row against the library."""
    import hashlib

    from emberline.llm.queries import CATALOG

    other = library(public_tokenizers.path(FILES[1]))
    got = {r.doc_id: r for r in CATALOG.queries["op11_byte_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = other.encode_ordinary(d.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want
