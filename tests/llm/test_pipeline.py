import hashlib
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline
from codelode.llm import bpe, language
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_ngram_join import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, left):
        df = stages[name](spark, spark.createDataFrame(left, docs.schema), SF)
        assert df.columns == columns
        return sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])

    first = stage("language", rows)
    learned = language.learn(docs.where(~language.held_out(docs.doc_id)))
    classifier = language.Classifier(learned)
    assert [r["doc_id"] for r in first] == sorted(r["doc_id"] for r in rows if not classifier.classify(r["text"])[3])
    assert len(first) >= 0.97 * len(rows)
    second = stage("exact", first)
    assert [r["doc_id"] for r in second] == sorted(i for i, _, _, kept, _ in exact_brute([(r["doc_id"], r["text"]) for r in first]) if kept)
    third = stage("near", second)
    assert [r["doc_id"] for r in third] == sorted(i for i, _, c in near_brute([(r["doc_id"], r["text"]) for r in second]) if i == c)
    fourth = stage("mix", third)
    assert set(Counter(r["doc_id"] for r in fourth).values()) <= {1, 2, 3} and {r["doc_id"] for r in fourth} <= {r["doc_id"] for r in third}
    size, mixed = defaultdict(int), defaultdict(int)
    for r in third:
        size[r["source"]] += len(r["text"].split())
    for r in fourth:
        mixed[r["source"]] += len(r["text"].split())
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size))}
    low, high = (sum(mixed[s] for s in size if weight[s] == w) for w in (1, 3))
    assert low < high and 0.8 < sum(mixed.values()) / sum(size.values()) < 1.2
    out = stages["tokens"](spark, spark.createDataFrame(fourth, docs.schema), SF).collect()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in fourth}
    assert len(out) == len(fourth)
    for r in out:
        assert list(r.ids) == own.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    more = ["score", "margin", "rejected", "text_sha256", "kept", "_id", "_copy", "own", "c0", "size"]  # names that operators use
    columns = ["doc_id", "text", "lang", "source", "n_chars", *more]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in more)
    rows = [(1, "the one and only text of this table", "en", "a", 1), (1, "the one and only text of this table", "en", "a", 1),
            (None, "a null id is no matter for the text", "en", None, 1), (None, "another null id of another source", "en", "b", 1),
            (3, None, None, None, None), (4, "", "en", "a", 0), (5, "12 34", "en", "b", 5), (6, "word " * 60_000, "en", "b", 5)]
    for left in ([(*r, *more) for r in rows], []):
        df = spark.createDataFrame(left, schema)
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
            assert df.count() <= 3 * max(1, len(left))
            if name != "tokens":
                assert df.columns == columns
                assert all([r[c] for c in more] == more for r in df.collect())
    assert zlib.crc32(b"") % 5 == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
