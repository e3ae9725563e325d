from pyspark.sql import functions as F

from codelode.functions import classify
from codelode.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_normalisers(spark):
    assert one(spark, tx.normalize_strict(F.lit("parseHTTPBody_v2/to.json é!"))) == "parse httpbody v2 to json"
    assert one(spark, tx.normalize_loose(F.lit("toJson(x)-y"))) == "to json(x) y"
    assert one(spark, tx.normalize_dotted(F.lit("a/b\\c d!"))) == "a.b.c d"


def test_stem_guards(spark):
    assert one(spark, tx.stem(F.lit("parsing"))) == "pars"
    assert one(spark, tx.stem(F.lit("bus"))) == "bus"


def test_fts_tokens_fold_accents(spark):
    assert one(spark, tx.fts_tokens(F.lit("L'État to_json ñandú"))) == ["l", "etat", "to", "json", "nandu"]


def test_query_order(spark):
    make = lambda *w: F.array(*[F.lit(x) for x in w])
    assert one(spark, tx.in_query_order(make("keep", "alive"), make("stay", "x", "alive")))
    assert not one(spark, tx.in_query_order(make("b", "a"), make("a", "b")))


def test_evidence_prefers_body_over_signature(spark):
    assert one(spark, tx.evidence_line(F.lit("def pay(x):\n  return charge(x)"), F.array(F.lit("zz")))) == "return charge(x)"


def test_roles_and_languages(spark):
    expected = {
        "tests/a.py": ("test", "python"), "pkg/a_test.go": ("test", "go"), "docs/x.py": ("docs", "python"),
        "examples/x.rs": ("example", "rust"), "a/fixtures/x.json": ("fixture", "json"), "bin/run.rb": ("tool", "ruby"),
        "bin/console": ("source", None), "benches/b.rs": ("benchmark", "rust"), "src/main/java/org/docs/A.java": ("source", "java"),
        "lib/A.ts": ("source", "typescript"), "x/ATests.swift": ("test", "swift"), "k/p.pyx.tp": ("source", "cython"),
    }
    df = spark.createDataFrame([(p,) for p in expected], "path string")
    rows = df.select("path", classify.role(F.col("path")).alias("r"), classify.language(F.col("path"), F.lit("")).alias("l")).collect()
    assert {r["path"]: (r["r"], r["l"]) for r in rows} == expected
