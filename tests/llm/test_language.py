import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from codelode.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = language.held_out(F.col("doc_id"))
    learned = language.learn(docs.where(~fold).select("doc_id", "text", "lang"))
    assert sorted(learned) == ["de", "en", "es", "fr"]
    rows = language.identify(docs.where(fold), learned).collect()
    truth = dict(zip(*[pq.read_table("/root/testdata/sf0.01/documents.parquet")[c].to_pylist() for c in ("doc_id", "lang")]))
    assert {r.doc_id for r in rows} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.lang_pred == truth[r.doc_id] for r in rows]
    assert sum(right) / len(right) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.03


def test_edges(spark):
    rows = [(1, "the cat and the dog went home", "en", "x"), (2, "der hund und die katze gehen heim", "de", "x"), (3, "unlabelled", None, "x"), (4, None, "en", "x"), (None, "the null", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    learned = language.learn(df)
    assert sorted(learned) == ["de", "en"] and b"unlabelled" not in b"".join(learned.values()) and list(learned)[0] == "en"
    asked = spark.createDataFrame([(1, "the dog went"), (2, None), (3, ""), (4, "123 !?"), (5, "die katze und " * 9000), (5, "die katze und " * 9000)], "doc_id long, text string")
    got = sorted(map(tuple, language.identify(asked, learned).select("doc_id", "lang_pred", "rejected").collect()))
    assert got[:4] == [(1, "en", False), (2, "und", True), (3, "und", True), (4, "und", True)] and got[4] == got[5] == (5, "de", False)
    assert language.learn(df.limit(0)) == {}
    assert language.identify(asked, {}).where("lang_pred <> 'und'").count() == 0
    assert language.identify(asked.limit(0), learned).count() == 0


def test_rare_label_beside_many_short_texts(spark):
    many = spark.range(200_000).selectExpr("id doc_id", "'ab cd' text", "'en' lang")
    rare = spark.range(200_000, 200_020).selectExpr("id doc_id", "concat('zw', chr(97 + id % 20)) text", "'xx' lang")
    learned = language.learn(many.unionByName(rare))
    assert set(learned["xx"].split()) == {b"zw" + bytes([97 + i]) for i in range(20)}
    assert len(learned["en"]) == language.DICTIONARY_BYTES
