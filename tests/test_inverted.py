"""The inverted index in parts: tokens, rows and rankings equal those of the plain functions."""

import re

from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.operators import candidates as cd
from codelode.operators import clusters as cl
from codelode.operators import fulltext as ft
from codelode.operators import inverted, related
from codelode.workload import corpus

TEXTS = [
    "", "plain words and plain words", "camelCase HTTPServer2Go x9Y _under_score__", "École ÉTÉ naïve été", "ΑΣ ΑΣ. Σ ΑΣ'Α ΣΑΣΑ",
    "İstanbul Kelvin ſs ß", "三体 ½ Ⅷ ² a஋9", "new ࡰ letter\U00031350s Ƛ Ᲊ", "line\nbreak\r\n\tend A1b2C3",
]
UNITS = [
    (1, 0, "a fox and a foxTrot", "n", "p/q"), (1, 1, "to_json writes état fox fox", "to_json", "p/q"), (2, 2, "fox again", "to_json", "q"),
    (2, 2, "fox twice", "to_json", "q"), (3, 3, None, "n", "p"), (4, 4, "é É e", None, "x/y"), (5, 5, "no path", "n", None), (6, None, "null one", "m", "z"), (6, None, "null two", "m", "z"),
]


def units(spark):
    return spark.createDataFrame(UNITS, "file_id long, chunk_id long, text string, indexed_name string, path string").withColumns(
        {"kind": F.when(F.col("file_id") != 3, F.lit("function")), "role": F.lit("source")})


def test_tokens(spark):
    plain, strict = inverted.tokenizer(inverted.folding(spark))
    rows = spark.createDataFrame([(s,) for s in TEXTS], "s string").select(
        "s", tx.fts_tokens(F.col("s")).alias("plain"), tx.words(tx.normalize_strict(F.col("s"))).alias("strict")).collect()
    assert [(plain(r.s), strict(r.s)) for r in rows] == [(r.plain, r.strict) for r in rows]


def test_rows_hold_all_postings(spark):
    dealt = units(spark).repartition(3, "file_id")
    want = ft.postings(ft.unit_tokens(units(spark).filter("path is not null")), 16)
    keys = lambda df: sorted(map(str, df.select("bucket", "term", "chunk_id", "kind", "role", "dl", "tf", "places").collect()))
    placed = inverted.turned(dealt, 3, True).withColumn("bucket", ft.term_bucket(F.col("term"), 16))
    assert keys(ft.unpacked(inverted.opened(placed))) == keys(want)
    counted = inverted.turned(dealt, 3, False).withColumn("bucket", ft.term_bucket(F.col("term"), 16))
    assert keys(inverted.opened(counted).withColumn("places", F.lit(0))) == keys(want.withColumn("places", F.lit(0)))
    assert "Exchange" not in str(inverted.turned(units(spark).coalesce(1), 1, False)._jdf.queryExecution().executedPlan())
    said = inverted.sums(counted).first()
    whole = ft.corpus_stats(ft.unit_tokens(units(spark))).first()
    assert said["n"] == 9 and abs(said["avgdl"] - whole["avgdl"]) < 2  # a chunk without a path has no length


def test_ranks_by_part(spark, tmp_path):
    words = ["alpha beta", "beta gamma_delta fox", "fox fox alpha", "delta gamma nothing", "alpha fox beta gamma"]
    rows = [(i, "\n".join(words[(i + j) % 5] for j in range(1 + i % 4)), f"src{i % 10}", "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    index = corpus.stored_index(spark, str(tmp_path))
    asked = spark.createDataFrame([
        (1, "alpha fox", None, None, False, None, None), (2, "gamma delta", ["function"], None, False, ["src8"], "filter"),
        (3, "beta", None, ["source"], True, None, None), (4, "nowhere", None, None, False, None, None), (5, "fox", None, None, False, ["none/"], "filter"),
    ], "query_id long, question string, kinds array<string>, roles array<string>, exclude_support boolean, path_hints array<string>, path_mode string")
    got = cd.best_fts(index, asked, 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", plan)  # no row for each request and chunk
    order = [F.col("rank"), F.col("chunk_id")]
    best = lambda df: sorted(map(tuple, ft.best(df, ["query_id"], order, 7).select("query_id", "position", "chunk_id", F.round("rank", 8)).collect()))
    want = best(cd.fts_ranks(index, asked))
    assert best(got) == want and {r[0] for r in want} == {1, 2, 3}
    phrases = spark.createDataFrame([(1, "gamma delta"), (1, "fox"), (2, "gamma delta")], "query_id long, phrase string").crossJoin(
        asked.select("kinds", "roles", "exclude_support").limit(1))
    placed = ft.best_by_part(index, phrases.withColumn("scope", F.lit("all")), ["query_id"], None)
    ranked = ft.rank_requests(ft.weights(index.postings, index.terms, index.stats, phrases), phrases)
    assert best(placed) == best(ranked)


def test_terms_with_wildcards(spark):
    rows = [("a_c",), ("a%c",), ("b\\d",), ("ABC",), ("z",)]
    df = spark.createDataFrame(rows, "t string").select(F.array("t").alias("c_terms"), F.lit("aXc b\\d ABC").alias("text"), F.lit("N").alias("qualified_name"), F.lit("p").alias("path"))
    assert [r[0] for r in df.select(cl._has_any_term()).collect()] == [True, True, True, False, False]


def test_pairs_read_what_is_made_once(spark):
    """What every pair of a source and a test reads is a column of its test or source, not computed for the pair."""
    shown = str([score for _, score in related.signals()]) + str(related.candidate_flags())
    assert "regexp_extract_all" not in shown and "t_layout" in shown and "t_block_text" in shown and "task_tokens" in shown and "flat_modules" in shown
    lines = spark.createDataFrame([("nothing\nsome_Stem here\nlast",)], "text string").withColumns(
        {"stem": F.lit("stem"), "leaf": F.lit(None).cast("string")} | {c: F.array().cast("array<string>") for c in ("modules", "l_terms", "t_fixtures", "fixture_names", "t_blocks")})
    assert lines.select(related.first_line()).first()[0] == 2
