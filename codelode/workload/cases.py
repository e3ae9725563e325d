"""Match rows built from the documents so that every score feature and intent rule fires.

A document's first distinct words fill one of the ``CASES`` (by its id's remainder):
``{a}`` to ``{d}`` in small letters, ``{A}`` to ``{D}`` with a capital. The same texts
fill the SQL equivalents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import features, intent
from codelode.session import cut_lineage
from codelode.workload import corpus

FIELDS = ("kind", "name", "qualified_name", "path", "role", "text", "question")
SPARE_WORDS = ("alpha", "bravo", "charlie", "delta")


def _case(kind, name, qualified, question, path="lib/{d}/{b}_x.py", text="{c} {d} is here", role="source", hints=()):
    return {"kind": kind, "name": name, "qualified_name": qualified, "path": path, "role": role, "text": text, "question": question, "hints": tuple(hints)}


CASES = (
    _case("method", "{a}_{b}", "{C}.{a}_{b}", "where {c} {a} {b} is done"),
    _case("method", "__{a}__", "{c}.__{a}__", "what does __{a}__ of {c} do"),
    _case("method", "__init__", "{c}.__init__", "how is {c} initialized", text="    @property\n{c} x"),
    _case("function", "{a}_{b}", "{a}_{b}", "{a} then {b} and {c}"),
    _case("function", "handle_{a}_{b}", "handle_{a}_{b}", "{a} {b}"),
    _case("class", "{a}", "{a}", "class {a} here"),
    _case("function", "{a}_{b}", "{a}_{b}", "about {a}", path="lib/{a}_{b}.py"),
    _case("function", "note_{a}_docs", "note_{a}_docs", "{a}"),
    _case("method", "{b}", "{a}.{b}", "{a} {c} {d}"),
    _case("method", "get", "{a}.get", "{a} {c} {d}", text="@property\n {c} {d}"),
    _case("function", "{a}_for_{b}", "{a}_for_{b}", "{b}s {a}ing"),
    _case("function", "performing_{a}", "performing_{a}", "perform {a} {b}"),
    _case("function", "collect_{b}", "collect_{b}", "collect {a}", path="x/{a}.py"),
    _case("function", "{c}", "{c}", "{d}", path="x/{a}/{b}.py", hints=("x/{a}/{b}.py", "{a}", "a/{b}", "{b} {a}", "")),
    _case("method", "body", "V.body", "swiftui body", path="a/V.swift"),
    _case("method", "body", "V.body", "view body button {a}", path="a/{a}.swift"),
    _case("function", "{a}", "{a}", "flow collect {a}", path="a/{b}.kt", text="suspend flow emit"),
    _case("class", "{a}", "gradle.implementation.{a}", "gradle dependency {a}", path="a/build.gradle.kts", text="plugin version"),
    _case("class", "{a}", "{a}", "inject {b} module", path="a/{a}.kt", text="inject module koin factory"),
    _case("function", "{b}", "{a}.{b}", "extension receiver state", path="ui/{a}ViewModel.kt", text="fun {a}.{b}()"),
    _case("class", "{a}", "maven.dependency.{a}", "maven artifact {a}", path="x/pom.xml", text="<artifactId>{a}</artifactId>"),
    _case("function", "{a}", "{a}", "cython parallel", path="k/{a}.pyx", text="cdef nogil prange"),
    _case("method", "{a}", "{a}", "does {a}.{b}() set {c}_{d}?", path="tests/{a}.py", text="x.{b} (1)\n{c}_{d} = 2\n{a} {b}", role="test"),
    _case("function", "{a}", "{a}", "the {a} decorator and {b} decorators"),
    _case("class", "{a}Config", "{a}Config", "{a} config represented", path="config/{b}.py"),
    _case("class", "{a}", "{a}", "{a} serializer another different everything {b}"),
    _case("function", "{b}", "{b}", "{a}", path="x/{a}_hookspecs.py"),
    _case("function", "add_option", "add_option", "what does --{a} do"),
    _case("function", "x", "X.OPT_AB", "flag --ab of {a}"),
    _case("method", "model_dump", "BaseModel.model_dump", "BaseModel dump serialized {a}", path="x/model.py"),
    _case("method", "{a}_{b}", "ConfigParser.{a}_{b}", "ConfigParser {a} {b}"),
    _case("method", "do_{a}_{b}", "FooBar.do_{a}_{b}", "FooBar {a} and {b}"),
    _case("method", "send_{a}", "{B}.send_{a}", "{b} send {a}"),
    _case("function", "create_{a}", "create_{a}", "create the {a} object"),
    _case("function", "get_default_{a}", "get_default_{a}", "default {a} enabled decide"),
    _case("function", "{b}", "{b}", "where is {a}.{b} function defined", path="{a}/x.py"),
    _case("method", "{b}", "{A}.{b}", "module level {A}.{b}"),
    _case("function", "{a}", "{a}", "validate {a} {b}", path="x/{b}_validators.py"),
    _case("function", "to_dict", "to_dict", "convert object to dict"),
    _case("function", "jsonable_encoder", "x.jsonable_encoder", "convert model json compatible data"),
    _case("function", "starting_{a}", "starting_{a}", "start stop {a}"),
    _case("function", "main", "app.main", "entry point main console", path="app/__main__.py", text="run application"),
    _case("function", "to_json", "{a}.to_json", "export {a} as json", path="x/export.py"),
    _case("function", "generate", "report.generate", "generate reports", path="x/report.py"),
    _case("function", "{a}", "community.cluster.{a}", "community detection", path="x/cluster.py"),
    _case("function", "serve", "server.serve", "mcp server {a}", path="x/serve.py"),
    _case("function", "{a}", "extract_python", "extract code of {a}", path="x/extract.py"),
    _case("function", "build", "build_from_json", "build graph {a}", path="x/build.py"),
    _case("function", "_pick_seeds", "seed.{a}", "query seeds", path="x/serve.py"),
    _case("function", "detect_incremental", "manifest.incremental", "incremental indexing", path="x/detect.py"),
)


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and the columns of a match row, filled from each document."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{4,9}"), F.lit(0)))
    four = F.slice(F.concat(found, features.strings(SPARE_WORDS)), 1, 4)
    docs = corpus.table(spark, sf, "documents").select("doc_id", four.alias("w"), F.pmod("doc_id", F.lit(len(CASES))).cast("int").alias("case"))
    shapes = spark.createDataFrame(
        [(i, *(c[f] for f in FIELDS), list(c["hints"])) for i, c in enumerate(CASES)],
        "case int, " + ", ".join(f"{f} string" for f in FIELDS) + ", path_hints array<string>",
    )

    def filled(template):
        for i, field in enumerate("abcd"):
            word = F.element_at("w", i + 1)
            capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))
            template = F.replace(F.replace(template, F.lit("{" + field + "}"), word), F.lit("{" + field.upper() + "}"), capital)
        return template

    return docs.join(F.broadcast(shapes), "case").select(
        "doc_id", *(filled(F.col(f)).alias(f) for f in FIELDS), F.transform("path_hints", filled).alias("path_hints"))


def match_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every score feature, the score and its reasons, with the boost of the intent rules."""
    # written out between the steps: expressions of one step are used many times in the next
    ready = cut_lineage(features.prepare(cut_lineage(rows(spark, sf))))
    boosted = cut_lineage(intent.boosts(ready).withColumn("has_neighbours", F.col("doc_id") % 3 == 0))
    scored = features.evaluate(boosted)
    names = sorted(c for c in scored.columns if c.startswith("f_") and c not in ("f_norm", "f_word_reasons"))
    return scored.select("doc_id", *names, "boost", "score", F.array_join("why", "; ").alias("why"))


QUERIES = {"match_features": match_features}
