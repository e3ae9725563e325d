"""One-hop neighbours over the edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Neighbours listed per direction and in all.
PER_SIDE = 5
TOTAL = 8


def _top(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rn") <= k)


def neighbours(wanted: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Up to eight neighbours of each wanted symbol_id: outgoing first, then incoming.

    An incoming edge names the symbol by id, by qualified name or by name. The
    three are equi-joins. Edges are cut to the best few per key before the
    join: five by id, and nine by name, because at most four of those nine can
    already be among the edges found by id without filling the list. A name
    shared by a third of all edges therefore costs nine rows per symbol.
    """
    keys = wanted.select("symbol_id").distinct()
    me = keys.join(symbols.select("symbol_id", "name", "qualified_name"), "symbol_id")

    out = _top(
        edges.join(keys.withColumnRenamed("symbol_id", "source_symbol_id"), "source_symbol_id", "left_semi"),
        ["source_symbol_id"], [F.col("edge_id")], PER_SIDE,
    ).select(
        F.col("source_symbol_id").alias("symbol_id"), F.lit(0).alias("side"), F.col("rn"),
        F.col("kind").alias("relation"), F.col("target_name").alias("neighbour"),
        F.col("target_symbol_id").alias("other_id"), "edge_id",
    )

    linked = edges.filter("source_symbol_id is not null")
    order = [F.when(F.col("kind") == "symbol_conforms_to", 0).otherwise(1), F.col("edge_id")]
    slim = ["edge_id", "kind", "source_symbol_id"]
    by_id = _top(
        linked.join(keys.withColumnRenamed("symbol_id", "target_symbol_id"), "target_symbol_id", "left_semi"),
        ["target_symbol_id"], order, PER_SIDE,
    ).select(F.col("target_symbol_id").alias("symbol_id"), F.lit(0).alias("far"), *slim)
    names = me.select(F.col("name").alias("target_name")).union(
        me.select(F.col("qualified_name").alias("target_name"))
    ).distinct()
    named = _top(
        linked.join(names, "target_name", "left_semi"), ["target_name"], order, 2 * PER_SIDE - 1
    ).select("target_name", "target_symbol_id", *slim)
    by_name = None
    for column in ("qualified_name", "name"):
        part = named.join(
            me.select("symbol_id", F.col(column).alias("target_name")), "target_name"
        ).filter("target_symbol_id is null or target_symbol_id != symbol_id").select(
            "symbol_id", F.lit(1).alias("far"), *slim
        )
        by_name = part if by_name is None else by_name.unionByName(part)
    incoming = by_id.unionByName(by_name).distinct()
    entry = _top(incoming, ["symbol_id"], [F.col("far"), *order], PER_SIDE)
    relation = (
        F.when(F.col("kind") == "symbol_calls_name", "called_by_name")
        .when(F.col("kind") == "symbol_conforms_to", "conformed_to_by")
        .otherwise(F.concat(F.lit("incoming_"), "kind"))
    )
    sources = symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("qualified_name").alias("neighbour"))
    inc = entry.join(sources, "source_symbol_id").select(
        "symbol_id", F.lit(1).alias("side"), "rn", relation.alias("relation"), "neighbour",
        F.col("source_symbol_id").alias("other_id"), "edge_id",
    )

    both = _top(out.unionByName(inc), ["symbol_id"], [F.col("side"), F.col("rn")], TOTAL)
    place = symbols.select(
        F.col("symbol_id").alias("other_id"), F.col("file_id"), "start_line", "end_line"
    ).join(files.select("file_id", "path"), "file_id")
    return both.join(place.drop("file_id"), "other_id", "left").select(
        "symbol_id", F.col("rn").alias("place"), "relation", "neighbour", "path", "start_line", "end_line", "edge_id"
    )
