"""BM25 against the full-text module of the standard library's SQLite."""

import sqlite3

from pyspark.sql import functions as F

from codelode.operators import fulltext as ft

ROWS = [
    (1, "the quick brown fox", "a.b", "x/one.py"), (2, "to_json writes état fox fox", "to_json", "x/two.py"),
    (3, "the lazy dog to json", "dog", "y/three.py"), (4, "nothing here the", "n", "y/four.py"), (5, "the the the", "t", "z/five.py"),
]


def test_matches_sqlite(spark):
    units = spark.createDataFrame(ROWS, "chunk_id long, text string, indexed_name string, path string").withColumn(
        "kind", F.lit("function")).withColumn("role", F.lit("source"))
    tokens = ft.unit_tokens(units)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, text, name, path)")
    for chunk, text, name, path in ROWS:
        body = units.filter(F.col("chunk_id") == chunk).select(
            __import__("codelode.functions.text", fromlist=["x"]).searchable_text(F.col("text"), F.col("indexed_name"))).first()[0]
        con.execute("insert into t values (?,?,?,?)", (chunk, body, name, path))
    phrases = ["fox", "the", "to json", "etat", "json writes", "the the", "fox fox", "json to", "y four"]
    theirs = {
        (i, r[0]): round(r[1], 6)
        for i, p in enumerate(phrases) for r in con.execute("select id, bm25(t) from t where t match ?", (f'"{p}"',))
    }
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, phrase string")
    posts = ft.postings(tokens, 4, 2)
    ranked = ft.rank_requests(ft.weights(posts, ft.dictionary(posts), ft.corpus_stats(tokens, 4), asked), asked)
    ours = {(r["query_id"], r["chunk_id"]): round(r["rank"], 6) for r in ranked.collect()}
    assert ours == theirs


def test_layout_and_pruning(spark, tmp_path):
    assert ft.layout(0) == (16, 1) and ft.layout(10 ** 9) == (250, 1) and ft.layout(10 ** 13)[0] == ft.MAX_BUCKETS
    words = [(i, f"all word{i} word{i % 7}", "n", "p") for i in range(200)]  # one word is in every chunk
    units = spark.createDataFrame(words, "chunk_id long, text string, indexed_name string, path string").withColumn(
        "kind", F.lit("function")).withColumn("role", F.lit("source"))
    tokens = ft.unit_tokens(units)
    ft.postings(tokens, 8, 3).write.partitionBy("bucket").parquet(f"{tmp_path}/p")
    posts = spark.read.parquet(f"{tmp_path}/p")
    terms, stats = ft.dictionary(posts), ft.corpus_stats(tokens, 8)
    one = spark.createDataFrame([("word3",)], "phrase string")
    plan = ft.weights(posts, terms.where("true"), stats, one)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all("bucket#" in line.split("PartitionFilters")[1].split("]")[0] for line in filters)
    both = spark.createDataFrame([("all",), ("word3",), ("all word9",)], "phrase string")
    counts = {r["phrase"]: r["n"] for r in ft.weights(posts, terms, stats, both).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"all": 200, "word3": 29, "all word9": 1}
