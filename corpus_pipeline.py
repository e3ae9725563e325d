"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1. ``language``: documents whose language the classifier rejects go. It learns
   from the labelled rows of the stage's input outside the held-out fold.
2. ``exact``: of documents with equal text the one with the smallest id stays.
3. ``near``: of each group linked by word shingles (five words, similarity 0.8)
   the document with the smallest id stays.
4. ``mix``: sources are mixed to their target weights. A document's copies are the
   words that the mix takes from it over its size, rounded up or down by a hash of
   its id, source and text so that the sum of words keeps to the target; none means that it goes.
5. ``tokens``: byte-level BPE ids of every document, checked by decoding.

Rows with a null id pass stages 2 and 3 by their text and stage 4 by their source
like any others; documents without words leave in stage 4. Further columns pass all
stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import bpe, exact_dedup, language, mixing, ngram_join
from codelode.llm.common import written


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that clash with nothing, and the new name of each column."""
    names = {column: f"c{i}" for i, column in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = language.learn(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows, names = _plain(docs)
    found = language.identify(rows, learned, text_col=names["text"])
    return found.where("not rejected").select(*names.values()).toDF(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    rows, names = _plain(docs)
    same = F.col(names["doc_id"]).eqNullSafe(F.col("kept_id")) & (exact_dedup.digest(F.col(names["text"])) == F.col("text_sha256"))
    return rows.join(kept, same, "left_semi").toDF(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = ngram_join.ngram_join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(linked, "doc_id", "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, seed: int = 7) -> DataFrame:
    rows, names = _plain(docs)
    own = F.xxhash64(*(names[c] for c in ("doc_id", "source", "text")))  # ids may be null or repeat in other sources
    rows = rows.withColumn("own", own)
    sized = rows.select(F.col("own").alias("doc_id"), F.col(names["source"]).alias("source"), F.col(names["text"]).alias("text"))
    mixed = mixing.mix_sources(sized).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    times = mixed.where("size > 0").select(
        F.col("doc_id").alias("own"), F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias("times")
    ).where("times > 0")
    copied = rows.join(times, "own").withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    return copied.select(*names.values()).toDF(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(rows, ranks, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: Compression, shingle hashes, the drawing of blocks and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
