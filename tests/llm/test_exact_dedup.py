import hashlib
import re
from collections import defaultdict

from codelode.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, kept int"


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_against_brute_force(spark):
    rows = [(i, f"text {i % 17 if i % 3 else 0}\t\n x", "c", 1) for i in range(300)]
    rows += [(1000, None, "c", 1), (1001, "", "c", 1), (1002, " ", "c", 1), (1003, " ", "c", 1), (None, "", "c", 1),
             (1004, "long " * 50_000, "c", 1), (1004, "long " * 50_000, "c", 1), (None, "only null ids", "c", 1)]
    for support in (1 / 1024, 0.1, 0.9):
        assert run(spark, rows, support=support) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
