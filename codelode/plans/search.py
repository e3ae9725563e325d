"""Batch search: a DataFrame of requests in, ranked matches out, one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions import features, intent
from codelode.functions import text as tx
from codelode.operators import candidates as cd
from codelode.operators import fulltext as ft
from codelode.operators import graph
from codelode.operators import rank as rk
from codelode.schemas import DEFAULT_LIMITS, Limits
from codelode.session import cut_lineage

UNIT_COLUMNS = [
    "chunk_id", "symbol_id", "text", "name", "qualified_name", "kind", "symbol_start", "symbol_end", "path", "role",
]


def intent_candidates(
    index, queries: DataFrame, rules: Sequence[intent.LiteralRule], limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The ``limits.intents`` best-boosted symbols of each request's pool; none when tests are asked for."""
    wanted = queries.filter(~F.array_contains(F.coalesce("roles", F.array()), "test"))
    pool = cd.intent_pool(index, wanted, intent.seed_terms(wanted, rules), limits).filter("kind != 'module'")
    rows = (
        pool.select("query_id", "chunk_id", "rank", "position")
        .join(index.units.select(*UNIT_COLUMNS), "chunk_id")
        .join(wanted.select("query_id", "question"), "query_id")
    )
    boosted = intent.boosts(features.prepare(rows), rules)
    # the cut comes before the test on the boost: a test first would be pushed
    # down and repeat every rule expression inside the filter
    return ft.best(
        boosted.select("query_id", "chunk_id", "rank", "boost", "reasons", F.col("position").alias("pool_position")),
        ["query_id"], [F.col("boost").desc(), F.col("pool_position")], limits.intents,
    ).filter("boost > 0")


def score_candidates(index, queries: DataFrame, merged: DataFrame) -> DataFrame:
    """Join candidates with their rows and neighbours, then compute score and reasons.

    ``merged`` holds a few hundred rows per request at most and is read twice,
    so its lineage is cut first.
    """
    rows = cut_lineage(
        merged.join(index.units.select("chunk_id", "symbol_id"), "chunk_id")
    )
    near = graph.neighbours(rows.select("symbol_id"), index.symbols, index.edges, index.files)
    # at most eight entries per symbol
    lists = near.groupBy("symbol_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "relation", "neighbour", "path", "start_line", "end_line"))).alias("neighbours")
    )
    full = (
        rows.join(index.units.select(*UNIT_COLUMNS).drop("symbol_id"), "chunk_id")
        .join(queries.select("query_id", "question", "path_hints", "expand", "limit"), "query_id")
        .join(lists, "symbol_id", "left")
    )
    expands = F.col("expand").isNull() | (F.size("expand") > 0)
    return features.evaluate(features.prepare(
        full.withColumn("neighbours", F.when(expands, F.col("neighbours")))
        .withColumn("has_neighbours", F.col("neighbours").isNotNull())
    ))


def search(
    index, queries: DataFrame, mode: str = "symbol",
    rules: Sequence[intent.LiteralRule] = intent.LITERAL_RULES, limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Ranked matches of every request.

    Columns: query_id, position, symbol, kind, file, start_line, end_line,
    score, adjusted, why, evidence, neighbours.
    """
    queries = queries if "question" in queries.columns else cd.with_question(queries)
    fts = cd.fts_candidates(index, queries, limits=limits)
    if mode == "fts":
        rows = fts.join(index.units.select(*UNIT_COLUMNS), "chunk_id").join(
            queries.select("query_id", "question", "limit"), "query_id"
        )
        matches = rk.rank(
            rows.withColumn("score", F.round(-F.col("rank"), 3)).withColumn(
                "why", F.array(F.lit("plain FTS match"))), mode,
        )
    else:
        merged = cd.merge(
            cd.exact_candidates(index, queries, limits), cd.path_hint_candidates(index, queries, limits),
            intent_candidates(index, queries, rules, limits), fts,
        )
        matches = rk.rank(score_candidates(index, queries, merged), mode)
    columns = [
        "query_id", "position", F.col("qualified_name").alias("symbol"), "kind", F.col("path").alias("file"),
        F.col("symbol_start").alias("start_line"), F.col("symbol_end").alias("end_line"),
        "score", "adjusted", "why",
        tx.evidence_line(F.col("text"), tx.ranked_tokens(F.col("question"))).alias("evidence"),
    ]
    return matches.select(*columns, *([] if mode == "fts" else ["neighbours"]))
