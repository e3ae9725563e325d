"""Registered queries: each operator run over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.operators import candidates as cd
from codelode.operators import clusters, graph, related
from codelode.operators import source_tests as st
from codelode.operators import evaluate as ev
from codelode.operators import extract
from codelode.operators import fulltext as ft
from codelode.operators import index as ix
from codelode.plans import search
from codelode.workload import cases, corpus, navigation


def files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.files(corpus.table(spark, sf, "documents"))


def role_counts(spark, sf):
    return ix.role_counts(files(spark, sf))


def symbols(spark, sf):
    return corpus.relations(spark, sf).symbols


def edges(spark, sf):
    return corpus.relations(spark, sf).edges.drop("confidence")


def relation_counts(spark, sf):
    return ix.relation_counts(corpus.relations(spark, sf))


def implementation_edges(spark, sf):
    rel = corpus.stored_index(spark, sf)
    return ix.implementation_edges(rel.edges, rel.symbols).select("source_symbol_id", "target_symbol_id", "target_name")


def postings(spark, sf):
    return corpus.stored_index(spark, sf).counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences"), F.sum("dl").alias("length_sum")
    )


def corpus_stats(spark, sf):
    units = corpus.relations(spark, sf).units()
    return ft.corpus_stats(ft.unit_tokens(units)).select(
        F.col("n").cast("long").alias("n"), F.round("avgdl", 6).alias("avgdl")
    )


def fts_topk(spark, sf):
    out = cd.fts_candidates(corpus.stored_index(spark, sf), corpus.requests(spark, sf))
    return out.withColumn("rank", F.round("rank", 6))


def exact_symbol_candidates(spark, sf):
    return cd.exact_candidates(corpus.stored_index(spark, sf), corpus.requests(spark, sf))


def path_hint_candidates(spark, sf):
    return cd.path_hint_candidates(corpus.stored_index(spark, sf), corpus.requests(spark, sf))


def intent_pool(spark, sf):
    out = cd.intent_pool(corpus.stored_index(spark, sf), corpus.requests(spark, sf))
    return out.withColumn("rank", F.round("rank", 6))


def candidate_merge(spark, sf):
    idx, q = corpus.stored_index(spark, sf), corpus.requests(spark, sf)
    merged = cd.merge(cd.exact_candidates(idx, q), cd.path_hint_candidates(idx, q), None, cd.fts_candidates(idx, q))
    return merged.select(
        "query_id", "chunk_id", "boost", F.round("rank", 6).alias("rank"), "fts_position",
        (F.col("first_source") * 1000 + F.col("first_position")).alias("first_place"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        files, role_counts, symbols, edges, relation_counts, implementation_edges, postings,
        corpus_stats, fts_topk, exact_symbol_candidates, path_hint_candidates, intent_pool, candidate_merge,
    )
}


def neighbours(spark, sf):
    """Neighbours of every symbol."""
    idx = corpus.stored_index(spark, sf)
    near = graph.neighbours(idx.symbols.select("symbol_id"), idx.symbols, idx.edges, idx.files)
    return near.select("symbol_id", "place", "relation", "neighbour", "path", "edge_id")


def search_fts(spark, sf):
    out = search.search(corpus.stored_index(spark, sf), corpus.requests(spark, sf), "fts")
    return out.select("query_id", "position", "symbol", "kind", "file", "start_line", F.round("score", 2).alias("score"), "evidence")


def _ranked(spark, sf, mode):
    out = search.search(corpus.stored_index(spark, sf), corpus.requests(spark, sf), mode)
    return out.select(
        "query_id", "position", "symbol", "kind", "file", "start_line", "end_line", "score", "adjusted",
        F.array_join("why", "; ").alias("why"), "evidence", F.size(F.coalesce("neighbours", F.array())).alias("neighbours"),
    )


def search_symbol(spark, sf):
    return _ranked(spark, sf, "symbol")


def search_hybrid(spark, sf):
    return _ranked(spark, sf, "hybrid")


def file_clusters(spark, sf):
    out = clusters.file_clusters(corpus.stored_index(spark, sf), corpus.requests(spark, sf))
    return out.select(
        "query_id", "position", "file", "role", "language", "plan", F.round("score", 1).alias("score"),
        "matched_chunks", "context_chars", "context_tokens", "coverage", "evidence",
        F.array_join("symbols.name", ",").alias("symbols"),
    )


QUERIES.update({f.__name__: f for f in (neighbours, search_fts, search_symbol, search_hybrid, file_clusters)})


def _sources(spark, sf):
    """Every source document asks for its tests, by its longest words and first function."""
    docs = corpus.table(spark, sf, "documents")
    idx = corpus.stored_index(spark, sf)
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{11,}"), F.lit(0)), F.lower))
    first = idx.symbols.filter("kind = 'function'").groupBy("file_id").agg(F.min_by("qualified_name", "symbol_id").alias("symbol"))
    return (
        idx.files.filter("role = 'source'").join(docs.select(F.col("doc_id").alias("file_id"), words.alias("terms")), "file_id")
        .join(first, "file_id", "left")
        .select(F.col("file_id").alias("source_id"), F.col("path").alias("source_file"), "symbol", "terms", F.lit(5).alias("limit"))
    )


def related_tests(spark, sf):
    out = related.related_tests(corpus.stored_index(spark, sf), _sources(spark, sf))
    return out.select("source_id", "position", "file", "score", F.array_join("why", "; ").alias("why"), "first_line")


def source_tests(spark, sf):
    out = st.source_tests(corpus.stored_index(spark, sf), corpus.requests(spark, sf))
    return out.select(
        "query_id", "position", "file", "bundle_score", "context_tokens",
        F.array_join("tests.file", ",").alias("tests"), F.array_join(F.get("tests", F.lit(0))["why"], "; ").alias("test_why"),
    )


QUERIES.update({f.__name__: f for f in (related_tests, source_tests)})


def _expected(spark, sf):
    """A document is expected for a benchmark item when they share a line."""
    docs = corpus.paths(corpus.table(spark, sf, "documents"))
    lines = docs.select("path", F.explode(F.split("text", "\n")).alias("line")).distinct()
    items = corpus.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.join(items, "line").select("query_id", F.lit("file").alias("kind"), F.col("path").alias("value")).distinct()


def retrieval_metrics(spark, sf):
    results = search.search(corpus.stored_index(spark, sf), corpus.requests(spark, sf), "fts").select("query_id", "position", "file", "symbol")
    out = ev.retrieval_metrics(ev.expected_hits(results, _expected(spark, sf)))
    return out.select("questions", "file_hit_1", "file_hit_5", "file_mrr", "partial_files")


def _question_terms(spark, sf):
    terms = F.transform("terms", lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    return corpus.requests(spark, sf).select("query_id", F.explode(terms).alias("term"))


def lexical_baseline(spark, sf):
    out = ev.file_baseline(_question_terms(spark, sf), corpus.paths(corpus.table(spark, sf, "documents")).select("path", "text"))
    return out.select("query_id", "position", F.col("path").alias("file"), "score")


def line_baseline(spark, sf):
    out = ev.line_baseline(_question_terms(spark, sf), corpus.paths(corpus.table(spark, sf, "documents")).select("path", "text"))
    return out.select("query_id", "position", F.col("path").alias("file"), "score", "matched_lines")


def _turns(spark, sf):
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}]{6,}"), F.lit(0)), F.lower))
    return corpus.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("step"), "role", "text",
        F.ceil(F.length("text") / 4).alias("tokens"), words.alias("found"),
    )


def workflow_summary(spark, sf):
    """Each conversation is a case: which later turns bring up the words of the first one."""
    turns = _turns(spark, sf)
    expected = turns.filter("step = 1").select("case_id", F.col("found").alias("wanted"))
    return ev.workflow_summary(turns.filter("step > 1"), expected)


def mention_rates(spark, sf):
    """Do the answers of a conversation mention the words of its opening question?"""
    turns = _turns(spark, sf)
    answers = turns.filter("role = 'assistant'").groupBy("case_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "text"))), lambda s: s["text"]), " ").alias("text"))
    return ev.mention_rates(answers, turns.filter("step = 1").select("case_id", F.explode("found").alias("value")))


def leaked_targets(spark, sf):
    """Benchmark requests that already name one of their expected files by its stem."""
    stems = _expected(spark, sf).select(
        F.col("query_id").alias("case_id"), tx.strip_extension(tx.basename(F.col("value"))).alias("stem")).distinct()
    targets = stems.groupBy("case_id").agg(F.array_sort(F.collect_set("stem")).alias("targets"))
    asked = corpus.requests(spark, sf).select(F.col("query_id").alias("case_id"), F.col("terms").alias("queries"))
    return ev.leaked_targets(asked.join(targets, "case_id"))


def run_spread(spark, sf):
    out = ev.group_medians(corpus.table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", "low", "median", "high", "runs", F.round("spread", 4).alias("spread"))


def _user_runs(spark, sf, kind):
    return corpus.table(spark, sf, "events").filter(F.col("event_type") == kind).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("value"), 6).alias("quality"), F.max("value").alias("tokens"))


def suite_weighted_means(spark, sf):
    return ev.weighted_means(_user_runs(spark, sf, "view"), "cases", ["quality", "tokens"])


def artifact_regressions(spark, sf):
    """Clicks of each user compared with their views as the baseline run."""
    return ev.compare_artifacts(_user_runs(spark, sf, "view"), _user_runs(spark, sf, "click"), "user_id", ["cases", "quality"], {"tokens": 0.1})


def condition_summary(spark, sf):
    e = corpus.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    reviews = e.select(
        F.col("event_type").alias("condition"),
        F.when(F.col("value") >= 20, "pass").when(F.col("value") >= 5, "partial").otherwise("fail").alias("success"),
        (k % 6).alias("quality"), k.alias("tokens"),
        F.when(F.col("value") < 5, F.concat(F.lit("mode_"), (k % 7).cast("string"))).alias("failure_mode"),
    )
    shown = F.transform("failures", lambda x: F.concat_ws(":", x["mode"], x["n"].cast("string")))
    return ev.condition_summary(reviews).withColumn("failures", F.array_join(shown, ","))


def trace_report(spark, sf):
    kinds = {"view": "index-query", "error": "search-fallback", "purchase": "code-change", "signup": "verification"}
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("lesson"))
    e = corpus.table(spark, sf, "events").select(
        F.col("user_id").alias("session"), kind.alias("type"),
        F.when(F.col("value") >= 10, "useful").otherwise("noise").alias("outcome"), "ts")
    return ev.trace_report(e)


def evidence_lines(spark, sf):
    """Evidence of every document for the words of five letters or more of its last line."""
    docs = corpus.table(spark, sf, "documents")
    last = F.element_at(F.split("text", "\n"), -1)
    terms = F.array_distinct(F.transform(F.regexp_extract_all(last, F.lit("[A-Za-z]{5,}"), F.lit(0)), F.lower))
    return docs.select("doc_id", tx.evidence_line(F.col("text"), terms).alias("evidence"))


def text_kernels(spark, sf):
    """All normalisers and the stemmer over every conversation turn."""
    c = F.col("text")
    return corpus.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.normalize_strict(c).alias("strict"), tx.normalize_loose(c).alias("loose"),
        tx.normalize_dotted(c).alias("dotted"), tx.normalize_target(c).alias("target"),
        F.array_join(tx.ranked_tokens(c), " ").alias("ranked"), F.array_join(tx.fts_tokens(c), " ").alias("fts"),
        tx.token_estimate(F.length(c)).alias("tokens"),
    )


QUERIES.update({
    f.__name__: f
    for f in (
        retrieval_metrics, lexical_baseline, line_baseline, workflow_summary, mention_rates, leaked_targets,
        run_spread, suite_weighted_means, artifact_regressions, condition_summary, trace_report,
        evidence_lines, text_kernels,
    )
})


def extract_symbols(spark, sf):
    """Symbols found in code written from the documents."""
    return extract.symbols(corpus.code_files(spark, sf)).select(
        "file_id", "symbol_id", "name", "qualified_name", "kind", "start_line", "end_line", "parent_symbol_id")


def extract_edges(spark, sf):
    """Edges found in code written from the documents."""
    return extract.extract(corpus.code_files(spark, sf)).edges.select(
        "edge_id", "source_symbol_id", "target_symbol_id", "target_name", "kind", "confidence")


def extract_chunks(spark, sf):
    rel = extract.extract(corpus.code_files(spark, sf))
    return rel.chunks.select("chunk_id", "symbol_id", "start_line", "end_line", F.sha2("text", 256).alias("hash"))


def extract_statements(spark, sf):
    """Symbols of code in five languages that holds comments, long strings and signatures over several lines."""
    return extract.symbols(corpus.trap_files(spark, sf)).select(
        "file_id", "symbol_id", "name", "qualified_name", "kind", "start_line", "end_line", "parent_symbol_id")


QUERIES.update({f.__name__: f for f in (extract_statements, extract_symbols, extract_edges, extract_chunks)})
QUERIES.update(cases.QUERIES)
QUERIES.update(navigation.QUERIES)
