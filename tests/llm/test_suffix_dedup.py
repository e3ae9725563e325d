import random
from collections import Counter

import numpy as np
import pytest

from codelode.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_bytes string, key int"


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:len(t)]
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((r[0], len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    passages = [text(length // 2) for _ in range(4)] + [text(length // 8) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(1, 60)) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(1, rng.choice(passages)[rng.randrange(20):])
        rows.append((i, "".join(parts), "c", 0))
    for i in range(60, 90):  # near copies
        base = list(rng.choice(rows)[1])
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = "#"
        rows.append((i, "".join(base), "c", 0))
    rows += [(90, None, "c", 0), (91, "", "c", 0), (92, "a" * (3 * length), "c", 0), (93, "ab" * length + "x", "c", 0), (94, "q" * length, "c", 0),
             (95, "q" * (length - 1), "c", 0), (None, rows[5][1], "c", 0), (96, "one twice " * 60, "c", 0), (96, "one twice " * 60, "c", 0),
             (97, text(30_000) + passages[0] + text(10), "c", 0)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, length):
    df = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), length)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length", [100, 400])
def test_against_brute_force(spark, length):
    rows = corpus(length, length)
    assert run(spark, rows, length) == brute(rows, length)


def test_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_BYTES", 2000)
    rows = corpus(7, 100)
    assert run(spark, rows, 100) == brute(rows, 100)


@pytest.mark.parametrize("shards", [1, 2, 4, 9])
def test_merged_transforms(shards):
    rng = random.Random(shards)
    common = [bytes(rng.choice(b"ab") for _ in range(500)) for _ in range(3)]
    texts = []
    for _ in range(40):
        at, n = rng.randrange(300), rng.randrange(150, 420)
        texts.append(rng.choice(common)[at:at + n] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(120))))
    texts += [b"a" * 300, texts[0], b"b" * 150, b"ab" * 100]
    classes, size = sd.repeated(texts, 150, shards)
    want = Counter(t[i:i + 150] for t in texts for i in range(len(t) - 149))
    for t, own in zip(texts, classes):
        assert [int(size[c]) if c >= 0 else 1 for c in own] == [want[t[i:i + 150]] for i in range(len(t) - 149)]


def test_pieces_cover_every_window(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(97, 101, 3000), np.full(9000, 97), rng.integers(97, 101, 3000)]).astype(np.uint8)
    key, _, start, size, places = sd.pieces(data, 400)
    assert start[0] == 0 and (start[1:] == start[:-1] + size[:-1]).all() and start[-1] + size[-1] == len(data) - 399 and size.max() <= sd.PIECE
    grams = sd.byte_hashes(data).every(sd.GRAM)
    assert all(key[i] == grams[start[i]:start[i] + 385].min() for i in range(len(key)))
    assert places.min() == 1 and places.max() > 400
    monkeypatch.setattr(sd, "BLOCK", 1000)
    other = sd.pieces(data, 400)
    assert (np.repeat(other[0], other[3]) == np.repeat(key, size)).all()


def test_empty(spark):
    assert run(spark, [], 400) == []
