import math
import random

import pytest

from codelode.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in kept:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("case", ["plain", "ties", "large"])
def test_against_brute_force(spark, case):
    rng = random.Random(2)
    scale = {"plain": 1.0, "ties": 0.004, "large": 2e5}[case]
    rows = [(i, [struct_float(rng.gauss(0, scale) * (1 + i % 7) / (1 + d)) for d in range(24)], "x") for i in range(700)]
    rows += [(1000, None, "x"), (1050, [1.0, float("nan")] + [0.0] * 22, "x"), (1100, [None] + [1.0] * 23, "x"), (1150, [float("inf")] * 24, "x"), (1201, rows[3][1], "x"), (1202, rows[3][1], "x"), (1250, [0.0] * 24, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, topk.top_k(df, block_rows=100, group_rows=7, head=6).collect()))
    assert got == brute(rows, 5, 50)


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, [3.0, -4.0], "b")], SCHEMA)
    assert sorted(map(tuple, topk.top_k(df).collect())) == [(0, 1, 1, 256 * 256 * -5)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_other_lengths_take_no_part(spark):
    rows = [(i, [float(i % 7), 1.0 + i % 3, -0.5 * i], "x") for i in range(60)]
    odd = [(100, [], "x"), (150, [1.0], "x"), (151, [1.0, 2.0], "x"), (200, [9.0] * 4, "x")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, block_rows=20).collect())) == brute(rows, 5, 50)
    assert topk.top_k(df.where("size(embedding) = 0")).count() == 0
