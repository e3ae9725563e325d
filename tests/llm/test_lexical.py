import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codelode.llm import lexical

DOCS = "doc_id long, text string, term string, n int, score double, mark int"
ITEMS = "item_id long, text string, rank string, doc_id int"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs // total if total else 0)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=20):
    d = spark.createDataFrame([(*r, "c", 0, 0.5, 1) for r in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(*r, "c", 1) for r in items], ITEMS)
    return sorted(map(tuple, lexical.search(d, q, k).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + [f"Ünï{i}" for i in range(300)] + ["THE", "the", "7"]
    draw = lambda n: " ".join(rng.choice(vocab[:rng.choice([5, 40, 333])]) for _ in range(n))
    docs = [(i, draw(rng.choice([0, 1, 5, 40, 200]))) for i in range(150)]
    docs += [(i, "the same text w1, w2") for i in range(200, 260)] + [(3, docs[3][1]), (None, docs[4][1]), (None, None), (300, None), (301, " -- "), (302, "w3 " * 20_000), (303, "x" * 1_500_000)]
    items = [(i, draw(rng.choice([1, 3, 20, 60]))) for i in range(12)] + [(20, None), (21, ""), (22, "?!"), (23, "same same"), (23, "the w1"), (23, "the w1"), (None, "w3 ünknown"), (24, "X" * 1_500_000), (25, "nowhere")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert run(spark, docs, items) == brute(docs, items, 20)


def test_small_shards_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD_DOCS", 25), ("BLOCK_TERMS", 40), ("STEP", 1), ("CELLS", 8), ("CHUNK_CHARS", 200)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(3)
    assert run(spark, docs, items, 7) == brute(docs, items, 7)


def test_descent_visits_few_cells():
    rng = np.random.default_rng(5)
    row = np.concatenate([np.repeat(np.arange(100), 20), np.full(4000, 100)])
    column = np.concatenate([np.arange(2000), np.arange(4000)])
    impact = rng.integers(1, 1000, len(row))
    treap = lexical.Treap(row, column, impact)
    scores = np.zeros(4000, np.int64)
    np.add.at(scores, column[row == 7], 500 * impact[row == 7])
    np.add.at(scores, column[row == 100], impact[row == 100])
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(self)[at]

    treap.most = [m.view(Counted) for m in treap.most]
    best, found = treap.search(np.array([7, 100]), np.array([500, 1]), np.arange(1 << treap.levels), 3)
    assert best.tolist() == np.lexsort((np.arange(4000), -scores))[:3].tolist() and found.tolist() == scores[best].tolist()
    assert sum(seen) < 1500


def test_wide_counts():
    n = np.array([10 ** 9, 5])
    assert lexical._impacts(n, np.array([1, 2]), 10 ** 11, 10 ** 13).tolist() == [10 ** 9 // (1000 + 12 * (75 + 25 * 10 ** 9 // 100)), 2 * 10 ** 9 // (2000 + 12 * 76)]


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []
