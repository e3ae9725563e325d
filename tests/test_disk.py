"""What the index writes out: no posting goes through a shuffle, no token is stored."""

import os

from pyspark.sql import functions as F

from codelode.operators import fulltext as ft
from codelode.operators import index as ix

UNITS = [
    (1, "a fox and a fox", "n", "p"), (2, "fox to json", "to_json", "q"), (2, "fox again", "to_json", "q"), (3, None, "n", "p"), (4, "é É e", None, "x/y"),
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def units(spark, rows=UNITS):
    return spark.createDataFrame(rows, "chunk_id long, text string, indexed_name string, path string").withColumns(
        {"kind": F.lit("function"), "role": F.lit("source")})


def rows_of(df):
    return sorted((r.term, r.chunk_id, r.dl, r.tf, tuple(r.places)) for r in df.collect())


def test_postings_without_a_shuffle(spark):
    once = ft.unit_tokens(units(spark, [r for r in UNITS if r[0] != 2]))
    posts = ft.postings(once, 4, None)
    assert "Exchange" not in plan(posts)
    assert rows_of(posts) == rows_of(ft.postings(once, 4, 3))
    want = {}
    for r in ft.unit_tokens(units(spark)).collect():
        for i, t in enumerate(r.tokens):
            if t:
                want.setdefault((t, r.chunk_id, r.dl), []).append(i)
    # chunks whose id comes more than once are counted together
    got = rows_of(ft.postings(ft.unit_tokens(units(spark)), 4, None))
    assert got == sorted((t, c, dl, len(p), tuple(sorted(p))) for (t, c, dl), p in want.items())


def test_stored_index_holds_no_tokens(spark, tmp_path):
    files = spark.createDataFrame([(0, "lib/a.py", "h", "python", "source")], "file_id long, path string, hash string, language string, role string")
    symbols = spark.createDataFrame([(0, 0, "f", "f", "function", 1, 1, None)], "symbol_id long, file_id long, name string, qualified_name string, kind string, start_line int, end_line int, parent_symbol_id long")
    chunks = spark.createDataFrame([(0, 0, 0, "f", 1, 1, "def f")], "chunk_id long, file_id long, symbol_id long, symbol_name string, start_line int, end_line int, text string")
    edges = spark.createDataFrame([], "edge_id long, source_symbol_id long, target_symbol_id long, target_name string, kind string, confidence string")
    asked = []
    rel = ix.Relations(files, symbols, chunks, lambda: asked.append(1) or edges)
    assert not asked
    ix.write_index(rel, f"{tmp_path}/i", "r")
    assert asked == [1] and "tokens" not in os.listdir(f"{tmp_path}/i")
    index = ix.open_index(spark, f"{tmp_path}/i")
    tokens = ft.unit_tokens(index.units)
    assert index.stats.select("n", "avgdl").first() == ft.corpus_stats(tokens).select("n", "avgdl").first()
    assert rows_of(index.postings) == rows_of(ft.postings(tokens, 16))
