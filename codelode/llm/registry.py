"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import bpe, chat, exact_dedup, language, lexical, mixing, ngram_join, secrets, substring_dedup, suffix_dedup, token_count, topk, whitening


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf, "documents"))
    return found.select(
        "doc_id", *(secrets.count("base", kind).alias(f"n_{kind}") for kind in secrets.KINDS),
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
    )


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    fold = language.held_out(F.col("doc_id"))
    learned = language.learn(docs.where(~fold).select("doc_id", "text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_token_count(spark: SparkSession, sf: str, limit: int = 2048) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    counted = token_count.count_tokens(table(spark, sf, "documents"), vocabulary)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(
        "select -7L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text "
        "union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"
    )
    return chat.read_back(chat.format_windows(rows.unionByName(added)))


def op5_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf, "documents"))


def op6_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf, "documents"))


def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded"))


def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept"), (F.col("n_removed") > 0).alias("touched"),
    )


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"))


def op10_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings").select("vec_id", "embedding"))


def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
        "kept", (F.col("n_removed") > 0).alias("touched"),
    )


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_token_count": op3_token_count,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_ngram_join": op5_ngram_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op10_topk": op10_topk,
    "op11_lexical_search": op11_lexical_search,
    "op12_whitening": op12_whitening,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES = {
    "op5_ngram_join": """
with recursive w as (
  select doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+') as words
  from documents
), s as (
  select distinct doc_id, unnest(case
    when len(words) = 0 then []
    when len(words) < 5 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as shingle
  from w
), n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n
  having 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select reach.a, links.b from reach join links on reach.b = links.a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.component_id
from documents d
left join n on n.doc_id = d.doc_id
join (select a, min(b) as component_id from reach group by a) r on r.a = d.doc_id
""",
    "op6_exact_dedup": """
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256
  from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
""",
    "op10_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= 5
""",
    "op11_lexical_search": """
with d as (
  select doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents
), s as (
  select count(*) filter (len(terms) > 0) as docs, cast(sum(len(terms)) as bigint) as total from d
), p as (
  select doc_id, n, term, count(*) as tf
  from (select doc_id, len(terms) as n, unnest(terms) as term from d) group by doc_id, n, term
), q as (
  select item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark
), w as (
  select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from p group by term), s
), r as (
  select item_id, doc_id,
         cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) as bigint) as score
  from q join w using (term) join p using (term), s
  group by item_id, doc_id
)
select item_id, cast(rank as int) as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0
) where rank <= 20
""",
    "op13_substring_dedup": """
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
), s as (
  select doc_id, words, unnest(range(1, len(words) - 48)) as i from w
), k as (
  select doc_id, i, array_to_string(words[i:i + 49], ' ') as run from s
), hit as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by run) as low from k) where low < doc_id
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as i from hit
), kept as (
  select p.doc_id, count(*) as n, string_agg(word, ' ' order by p.i) as kept
  from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from w) p
  anti join gone on gone.doc_id = p.doc_id and gone.i = p.i
  group by p.doc_id
), r as (
  select w.doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, coalesce(kept, '') as kept
  from w left join kept on kept.doc_id = w.doc_id
)
select doc_id, n_words, n_removed, sha256(kept) as kept_sha256, kept, n_removed > 0 as touched
from r
""",
}
