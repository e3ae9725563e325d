from collections import defaultdict

import pytest

from codelode.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int"


def expected_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= cap * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= full
    return target


def rows():
    out, n = [], 0
    for s, (count, words) in {"a": (900, 40), "b": (100, 11), "c": (5, 3), None: (50, 90), "é": (300, 60)}.items():
        for i in range(count):
            out.append((n, " ".join(["w"] * (words + i % 7)), s, "x", 1))
            n += 1
    return out + [(n, None, "a", "x", 1), (n + 1, " \n", "zero", "x", 1), (n + 2, "w " * 30_000, "long", "x", 1), (3, "w w", "a", "x", 1), (3, "w w", "a", "x", 1)]


def test_mix(spark):
    data = rows()
    df = mixing.mix_sources(spark.createDataFrame(data, SCHEMA).repartition(4), block=8, shard_slots=512)
    got = [r.asDict() for r in df.collect()]
    assert len(got) == len(data)
    again = [r.asDict() for r in mixing.mix_sources(spark.createDataFrame(data, SCHEMA).repartition(2), block=8, shard_slots=512).collect()]
    key = lambda r: sorted(r.items())
    assert sorted(got, key=key) == sorted(again, key=key)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r[0]: r[2] for r in data}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = expected_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 16
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_steps_are_primes():
    for p in mixing.STEPS:
        assert all(p % q for q in range(2, 1_000_100))


def test_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mixing.mix_sources(spark.createDataFrame([(1, "", "a", "", 0)], SCHEMA)).collect()] == [0]
