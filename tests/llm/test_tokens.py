import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from codelode.llm import bpe, token_count
from tests.llm.texts import sample


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def merges():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return token_count.Merges(f.read())


def test_encoding_equals_the_library(ranks):
    texts = sample()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.Encoder(bpe.Vocabulary(ranks), P.PATTERN).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, np.int32).tolist() == own.encode_ordinary(text), repr(text[:200])


def test_both_trees_agree(ranks):
    vocab, rng = bpe.Vocabulary(ranks), random.Random(1)
    for width in (4, 8, 16, 32, 64):
        pieces = [bytes(rng.choice(b"theranigo ") for _ in range(rng.randrange(1, width + 1))) for _ in range(200)]
        assert bpe.encode_many(vocab, pieces, width) == [bpe.encode_long(vocab, p) for p in pieces]


def test_small_memory_gives_the_same(ranks, monkeypatch):
    texts = sample(50)
    want = bpe.Encoder(bpe.Vocabulary(ranks), P.PATTERN).encode(texts)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10)
    encoder = bpe.Encoder(bpe.Vocabulary(ranks), P.PATTERN)
    assert [encoder.encode([t])[0] for t in texts] == want


def test_round_trip(spark, ranks):
    texts = [*sample(40), None, "x" * 70_000]
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").drop("ids")
    got = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(df, ranks, P.PATTERN), ranks)).collect()}
    once = {r.doc_id: r for r in bpe.digests(bpe.encode(df, ranks, P.PATTERN, decoded="decoded")).collect()}
    assert got == once
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t, _ in rows:
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    empty = bpe.digests(bpe.decode(bpe.encode(df.limit(0), ranks, P.PATTERN), ranks))
    assert empty.count() == 0


def test_counts_equal_the_library(merges):
    texts = sample()
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = token_count.Counter(merges)
    got = counter.count(texts)
    assert merges.ordered
    for text, a, b in zip(texts, got, want):
        assert a == b, repr(text[:200])


def test_leftmost_place_alone_gives_the_same(merges):
    texts = sample(60)
    want = token_count.Counter(merges).count(texts)
    merges.ordered = False
    try:
        assert token_count.Counter(merges).count(texts) == want
    finally:
        merges.ordered = True


def test_count_rows(spark):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    df = spark.createDataFrame([(1, None, 2), (1, None, 2), (2, "é a", 3)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, token_count.count_tokens(df, vocabulary).collect()))
    assert rows == [(1, 0, 0), (1, 0, 0), (2, 4, 2)]
    assert token_count.count_tokens(df.limit(0), vocabulary).count() == 0
