"""Exact duplicates by digest, with frequent digests split off before the shuffle.

Texts are equal when they are identical after every run of white space
(``[\\x20\\x09-\\x0D]+``) is replaced by one space; a null text counts as empty.

1. A scan reduces each text to its SHA-256; only (id, digest) goes on.
2. A Misra-Gries summary (``freqItems``: at most ``1 / support`` counters in
   each task and in the merged result) names every digest that can hold more
   than ``support`` of the rows.
3. The named digests are counted exactly. Those that do hold that share, at
   most ``1 / support`` of them whatever the corpus, are broadcast, and their
   rows are decided where they lie.
4. The other digests take the ordinary path: a partial count and one shuffle.

Edge cases: an empty table gives no rows. Ids may repeat; rows that share both
id and text are one document and are all kept or all dropped. Null ids never win
against others and win only if a group has nothing else. Columns besides id and
text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import cut_lineage

WHITE = "[\\x20\\x09-\\x0D]+"
SUPPORT = 1 / 1024


def digest(text) -> F.Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")))
    heavy = _heavy(rows, support)
    marked = rows.join(F.broadcast(heavy), "text_sha256", "left")
    decided = marked.where(F.col("group_size").isNotNull())
    rest = marked.where(F.col("group_size").isNull()).select("doc_id", "text_sha256")
    groups = rest.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    ordinary = rest.join(groups, "text_sha256")
    return decided.unionByName(ordinary).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _heavy(rows: DataFrame, support: float) -> DataFrame:
    """The digests that really hold more than ``support`` of all rows, at most 1 / support."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    named = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    counted = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return counted.join(F.broadcast(total), F.col("group_size") > F.col("total") * F.lit(support)).drop("total")
