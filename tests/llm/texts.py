"""Awkward texts for the tokenizer tests."""

import random

import pyarrow.parquet as pq

FIXED = [
    "", " ", "a", "  a  b\n\n c\t", "It's we'LL I'm don't 'S", "1234 56 7٣", "ÀÉ straße ΣΑΣ İstanbul ﬁ", "é ñ", "日本語 テスト", "👩‍👩‍👧 ok",
    "<|endoftext|>", "x<|startoftext|><|endoftext|>y <|endoftext|", "a\x1cb\x1d \x1e\x1f\x85c\xa0d e​f᠎g　", "aaaaaaaaaaaaaaaaaaaaaaa", "=" * 300,
    "ab" * 4000, "!?!?" * 50, "\r\n\r\n x\r\n", "The quick brown fox " * 200, "  x", "KK ſ",
]


def sample(n=300, seed=3):
    rng = random.Random(seed)
    out = list(FIXED)
    pools = ["abcdefgh '", "abc \n\t.,;!?'\"0123", "éàüßñç ÀÉ", "".join(map(chr, range(0x20, 0x250))), "".join(chr(rng.randrange(0x20, 0xD7FF)) for _ in range(4000)) + " \n"]
    for _ in range(n):
        pool = rng.choice(pools)
        out.append("".join(rng.choice(pool) for _ in range(rng.randrange(1, 120))))
    out += pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    return out
