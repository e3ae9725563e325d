from types import SimpleNamespace

import pytest

from codelode.operators import candidates as cd
from codelode.operators import evaluate as ev
from codelode.operators import fulltext as ft
from codelode.schemas import ORDINAL_SPAN, Limits

QUERY = (
    "query_id long, question string, kinds array<string>, roles array<string>, exclude_support boolean, "
    "path_hints array<string>, path_mode string"
)


@pytest.fixture(scope="module")
def index(spark):
    # 120 source files outrank the few tests, which hold the word once in a long text
    rows = []
    for i in range(130):
        test = i >= 120
        text = "needle" if not test else "needle " + " ".join(f"pad{j}" for j in range(60))
        path = f"{'tests' if test else 'lib'}/f{i:03}.py"
        rows.append((i * ORDINAL_SPAN, i * ORDINAL_SPAN, i, f"s{i}", f"s{i}", f"s{i}", "function", 1, 1, path, "test" if test else "source", text))
    units = spark.createDataFrame(
        rows, "chunk_id long, symbol_id long, file_id long, name string, qualified_name string, indexed_name string, "
        "kind string, symbol_start int, symbol_end int, path string, role string, text string")
    tokens = ft.unit_tokens(units)
    return SimpleNamespace(
        units=units, files=units.select("file_id", "path", "role"), tokens=tokens, postings=ft.postings(tokens, 4), terms=ft.dictionary(ft.postings(tokens, 4)), stats=ft.corpus_stats(tokens, 4))


def test_filters_come_before_the_cut(spark, index):
    asked = spark.createDataFrame([
        (1, "needle", None, ["test"], False, None, None), (2, "needle", None, None, False, ["tests/"], "filter"),
        (3, "needle", None, None, False, None, None), (4, "needle", ["class"], None, False, None, None),
    ], QUERY)
    got = cd.intent_pool(index, asked).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 10, 2: 10, 3: 80}
    whole = cd.intent_pool(index, asked, limits=Limits(pool_word_rows=None, pool=None)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in whole} == {1: 10, 2: 10, 3: 130}


def test_medians(spark):
    rows = [("a", float(x)) for x in (5, -3, 5, 5, 100, -1e6, 7, 7)] + [("b", 1.5), ("c", None)]
    got = ev.group_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", -1e6, 5.0, 100.0, 8, 1000100.0), ("b", 1.5, 1.5, 1.5, 1, 0.0)]
