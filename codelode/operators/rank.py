"""Ranking of scored matches: symbol, full-text and hybrid order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelode.functions import text as tx


def _has(reason: str) -> Column:
    return F.array_contains(F.col("why"), reason)


def hybrid_parts() -> dict[str, Column]:
    """The three adjustments hybrid order adds to a score."""
    c = F.col
    method, function = c("kind") == "method", c("kind") == "function"
    leaf = tx.leaf(c("qualified_name"))
    dunder = method & leaf.startswith("__") & leaf.endswith("__")
    leaf_tokens = tx.words(tx.normalize_strict(leaf))
    intent = F.exists(c("why"), lambda r: r.contains("intent"))
    early = F.coalesce(c("fts_position") <= 5, F.lit(False))
    named = _has("method name match") | _has("method owner/name match")
    lexical = F.when(early & function, 4).when(
        early & method & ~dunder & (named | _has("method owner/source match")), 4
    ).otherwise(0)
    specificity = (
        F.when(function & _has("exact symbol name match") & _has("symbol token coverage match"), 3)
        .when(method & intent & F.array_contains(leaf_tokens, "call"), 14)
        .when(method & intent & named, 8)
        .when(method & intent, 4)
        .when(method & _has("method owner/name match"), 2)
        .when(
            method & F.coalesce(c("fts_position") <= 2, F.lit(False)) & ~dunder
            & (F.size(leaf_tokens) == 1) & _has("method name match"), 3,
        )
        .otherwise(0)
    )
    container = F.when(c("kind") == "module", -18).when(
        (c("kind") == "class") & (_has("symbol token coverage match") | intent) & ~_has("exact class name match"), -12
    ).otherwise(0)
    return {"lexical": lexical, "specificity": specificity, "container": container}


def first_per_symbol(matches: DataFrame, order: list[Column]) -> DataFrame:
    """The best row per request, file and symbol."""
    w = W.partitionBy("query_id", "path", "qualified_name").orderBy(*order)
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top(matches: DataFrame, order: list[Column]) -> DataFrame:
    """The request's ``limit`` best rows, numbered from 1."""
    w = W.partitionBy("query_id").orderBy(*order)
    return matches.withColumn("position", F.row_number().over(w)).filter(
        F.col("position") <= F.coalesce("limit", F.lit(5))
    )


def rank(matches: DataFrame, mode: str) -> DataFrame:
    """Order, deduplicate and cut. ``input_order`` breaks ties; ``score`` stays as shown."""
    tie = [F.col("first_source"), F.col("first_position"), F.col("chunk_id")]
    if mode == "fts":
        order = [F.col("fts_position")]
        adjusted = matches.withColumn("adjusted", F.col("score"))
    elif mode == "symbol":
        order = [F.col("score").desc(), *tie]
        adjusted = matches.withColumn("adjusted", F.col("score"))
    elif mode == "hybrid":
        order = [F.col("adjusted").desc(), *tie]
        adjusted = matches.withColumns(hybrid_parts()).withColumn(
            "adjusted", F.round(F.col("score") + F.col("lexical") + F.col("specificity") + F.col("container"), 3)
        )
    else:
        raise ValueError(f"unknown mode {mode}; choose symbol, fts or hybrid")
    return top(first_per_symbol(adjusted, order), order)
