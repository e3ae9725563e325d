import random
import re
from collections import defaultdict

import numpy as np
import pytest

from codelode.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, mark string, key int, runs double"


def brute(rows, length):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    least = defaultdict(lambda: None)
    for (i, *_), words in zip(rows, docs):
        for p in range(len(words) - length + 1):
            w = tuple(words[p:p + length])
            if i is not None and (least[w] is None or i < least[w]):
                least[w] = i
    out = []
    for (i, *_), words in zip(rows, docs):
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            low = least[tuple(words[p:p + length])]
            if low is not None and (i is None or low < i):
                gone[p:p + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), kept))
    return sorted(out, key=repr)


def run(spark, rows, length=50):
    df = spark.createDataFrame([(*r, "c", 1, 0.5) for r in rows], SCHEMA).repartition(5)
    got = sd.remove_repeats(df, length).collect()
    for r in got:
        words = sum(s.stop - s.first for s in r.spans)
        assert words == r.n_removed and len(r.kept.split()) == r.n_words - r.n_removed
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(60)] + ["a", "B"]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows = []
    for n in range(120):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 49, 50, 51, 120, 300]))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words) + 1)
            cut = rng.randrange(20)
            words[at:at] = passage[cut:cut + rng.choice([30, 49, 50, 52, 70])]
        rows.append((n, rng.choice([" ", "\n", "\t \r"]).join(words)))
        if rng.random() < 0.2:
            rows.append((rng.choice([n, n + 1000, None]), rows[-1][1]))
    rows += [(7, None), (None, None), (2000, ""), (2001, " \n"), (2002, "x " * 6000), (2003, "x " * 5000 + "y"), (-5, " ".join(passage)),
             (None, " ".join(passage)), (2004, "é" * 1_200_000), (2005, " ".join(f"u{i % 701}" for i in range(9000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows, 50)


def test_crowded_keys_and_small_batches(spark, monkeypatch):
    for name, value in (("GROUP_WORDS", 200), ("BATCH_WORDS", 300), ("PIECE", 7), ("BLOCK", 150), ("CHUNK_CHARS", 500)):
        monkeypatch.setattr(sd, name, value)
    rows = corpus(3)
    assert run(spark, rows, 12) == brute(rows, 12)


def test_tree_nodes():
    rng = np.random.default_rng(4)
    sizes = np.array([40, 3, 60, 25])
    words = rng.integers(1, 3, sizes.sum()).astype(np.uint64)
    tree = sd.SuffixTree(words, sizes, 6)
    ends = np.repeat(np.cumsum(sizes), sizes)
    text = {i: tuple(words[i:i + 6].tolist()) for i in range(sizes.sum()) if i + 6 <= ends[i]}
    assert sorted(tree.order.tolist()) == sorted(text) and [text[i] for i in tree.order] == sorted(text.values())
    for a, b, common in zip(tree.order, tree.order[1:], tree.common):
        assert common == next((k for k in range(6) if text[a][k] != text[b][k]), 6)
    groups = defaultdict(set)
    for i, w in text.items():
        groups[w].add(i)
    first, leaves = tree.nodes()
    assert {frozenset(tree.order[f:f + n].tolist()) for f, n in zip(first, leaves)} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_empty(spark):
    assert run(spark, []) == []
