"""Tables of a stored index are written when they are read; units need no join; pairs come from words that can score."""

import os

from pyspark.sql import functions as F

from codelode.operators import fulltext as ft
from codelode.operators import related
from codelode.workload import corpus


def documents(spark, where, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{where}/documents.parquet")
    return str(where)


LONG = " ".join(["Alpha beta"] * 30)
METHOD = " ".join(["gamma delta"] * 13)
ROWS = [(1, f"one\n{METHOD}\n{LONG}\n{METHOD}\n\ntwo words", "src0", "en"), (2, None, "src8", "de"), (3, "", "src9", "fr"), (None, "no id here", "src9", "fr")]


def test_units_without_a_join(spark, tmp_path):
    where = documents(spark, tmp_path, ROWS)
    joined, plain = corpus.relations(spark, where).units(), corpus.units(spark, where, 3)
    assert joined.dtypes == plain.dtypes and joined.count() == plain.count() == 7
    assert joined.exceptAll(plain).isEmpty()
    twice = documents(spark, tmp_path / "twice", ROWS + ROWS[:1])
    assert corpus.units(spark, twice) is None


def test_tables_are_written_when_read(spark, tmp_path):
    where = documents(spark, tmp_path, ROWS)
    index = corpus.stored_index(spark, where)
    folder = corpus._BUILT[spark.sparkContext.applicationId, where][0]
    assert index.symbols.count() == 9 and os.listdir(folder) == ["symbols"]
    assert "places" not in index.counts.columns and sorted(os.listdir(folder)) == ["counts", "symbols"]
    again = corpus.stored_index(spark, where)
    assert again.postings.drop("places").exceptAll(index.counts).isEmpty() and again.counts.count() == index.counts.count()
    assert again.terms.exceptAll(ft.dictionary(index.counts)).isEmpty()


def test_packed_places(spark):
    rows = [("a", 10, [0]), ("b", 10, [1, 2, 6]), ("c", 1, [3, 3]), ("d", 9, [0, 4, 5, 9, 11])]
    posts = spark.createDataFrame(rows, "term string, dl long, places array<int>").withColumns(
        {"bucket": F.lit(0), "chunk_id": F.lit(1).cast("long"), "kind": F.lit("k"), "role": F.lit("r"), "tf": F.size("places").cast("long")})
    back = ft.unpacked(ft.packed(posts)).select("term", "dl", "tf", "places")
    assert sorted(map(tuple, back.collect())) == [(t, n, len(p), p) for t, n, p in rows]


def test_pairs_need_a_word_that_can_score(spark):
    words = "array<string>"
    source = spark.createDataFrame(
        [(1, "alpha", "get_x"), (2, "beta", None)], "source_id long, stem string, leaf string").withColumns(
        {"leaf": F.when(F.col("leaf").isNotNull(), "ab wanted"), "s_tokens": F.array(F.lit("lib"), F.lit("7"), F.lit("py"), F.col("stem"))}
        | {c: F.array().cast(words) for c in ("path_terms", "cand_tokens", "layout", "l_terms", "fixture_names", "task_terms", "modules")}
        | {c: F.lit(None).cast("string") for c in ("l_symbol", "l_class")})
    tests = spark.createDataFrame([(10, "tests 7 gamma py"), (11, "tests beta py"), (12, "tests ab wanted py")], "file_id long, t_path string").withColumns(
        {c: F.lit("") for c in ("t_text", "t_tokens", "low_text")} | {"low_path": F.col("t_path")}
        | {c: F.array().cast(words) for c in ("flat_imports", "t_imports", "t_calls", "edge_calls")})
    # the ending, a number and the folder are no signals, nor is the first word of a name alone
    assert sorted(map(tuple, related.pairs(source, tests).collect())) == [(1, 12), (2, 11)]
