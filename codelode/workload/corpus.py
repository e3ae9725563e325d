"""The given text tables read as a code corpus.

Every document becomes a file. Its lines with two or more words become
symbols (short lines functions, longer ones methods, the longest classes) and
chunks; sentence openings become calls and conformances; first words of lines
become imports. Relations are derived from the tables, whole, and grow with
them.
"""

from __future__ import annotations

import string
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.functions import classify
from codelode.functions.ids import packed
from codelode.operators import index as ix
from codelode.schemas import ORDINAL_SPAN
from codelode.session import cut_lineage

_WORD = r"[A-Za-z]{2,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Long texts in fewer files than cores are spread over the cores first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and len(df.inputFiles()) < cores:
        return df.repartition(cores, "doc_id")
    return df


def _folder(source: Column) -> Column:
    return (
        F.when(source.isin("src0", "src1", "src2"), "tests")
        .when(source == "src3", "docs")
        .when(source == "src4", "examples")
        .when(source == "src5", "fixtures")
        .when(source == "src6", "tools")
        .when(source == "src7", "benchmarks")
        .otherwise("lib")
    )


def paths(documents: DataFrame) -> DataFrame:
    """doc_id, text and the path each document has as a file."""
    found = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
    slug = F.when(found == "", "doc").otherwise(F.lower(found))
    folder = _folder(F.col("source"))
    ending = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".go").when(
        F.col("lang") == "fr", ".rs").otherwise(".kt")
    name = F.concat(F.when(folder == "tests", "test_").otherwise(""), slug, ending)
    return documents.select(
        F.col("doc_id").alias("file_id"), "text",
        F.concat_ws("/", folder, F.col("source"), F.col("doc_id").cast("string"), name).alias("path"),
    )


def files(documents: DataFrame) -> DataFrame:
    return paths(documents).select(
        "file_id", "path", F.sha2("text", 256).alias("hash"),
        classify.language(F.col("path"), F.col("text")).alias("language"),
        classify.role(F.col("path")).alias("role"),
    )


def lines(documents: DataFrame) -> DataFrame:
    """Lines with their words; only those with two words or more."""
    split = documents.select(
        F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    ws = F.regexp_extract_all("line", F.lit(_WORD), F.lit(0))
    return split.select(
        "file_id", (F.col("pos") + 1).alias("line_no"), "line", ws.alias("ws")
    ).filter(F.size("ws") >= 2)


def _camel(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))


def _kind(ws: Column) -> Column:
    n = F.size(ws)
    return F.when(n >= 60, "class").when(n >= 25, "method").otherwise("function")


def _name(ws: Column) -> Column:
    first, second = F.get(ws, F.lit(0)), F.get(ws, F.lit(1))
    return F.when(F.size(ws) >= 60, F.concat(_camel(first), _camel(second))).otherwise(F.concat(F.lower(first), F.lit("_"), F.lower(second)))


def line_symbols(documents: DataFrame) -> DataFrame:
    first = F.get("ws", F.lit(0))
    named = lines(documents).select(
        "file_id", "line_no", "line", _kind(F.col("ws")).alias("kind"), _name(F.col("ws")).alias("name"),
        packed(F.col("file_id"), F.col("line_no")).alias("symbol_id"),
        F.lower(first).alias("first_word"),
        F.regexp_extract_all("line", F.lit(r"[.!?] ([A-Za-z]{2,} [A-Za-z]{2,})"), F.lit(1)).alias("openings"),
    )
    w = W.partitionBy("file_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("kind") == "class", F.struct("name", "symbol_id")), ignorenulls=True).over(w)
    owned = named.withColumn("prior", prior)
    is_member = (F.col("kind") == "method") & F.col("prior").isNotNull()
    return owned.withColumn(
        "qualified_name",
        F.when(is_member, F.concat("prior.name", F.lit("."), "name")).otherwise(F.col("name")),
    ).withColumn(
        "parent_symbol_id",
        F.when(is_member, F.col("prior.symbol_id")).otherwise(F.col("file_id") * ORDINAL_SPAN),
    ).drop("prior")


def relations(spark: SparkSession, sf_dir: str) -> ix.Relations:
    documents = table(spark, sf_dir, "documents")
    members = line_symbols(documents)
    module = paths(documents).select(
        (F.col("file_id") * ORDINAL_SPAN).alias("symbol_id"), "file_id", F.col("path").alias("name"),
        F.col("path").alias("qualified_name"), F.lit("module").alias("kind"), F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n")).alias("end_line"), F.lit(None).cast("long").alias("parent_symbol_id"),
        "text",
    )
    columns = ["symbol_id", "file_id", "name", "qualified_name", "kind", "start_line", "end_line", "parent_symbol_id"]
    inner = members.withColumn("start_line", F.col("line_no")).withColumn("end_line", F.col("line_no"))
    symbols = module.select(columns).unionByName(inner.select(columns))
    chunk_cols = [
        F.col("symbol_id").alias("chunk_id"), "file_id", "symbol_id",
        F.col("qualified_name").alias("symbol_name"), "start_line", "end_line",
    ]
    chunks = module.select(*chunk_cols, "text").unionByName(
        inner.select(*chunk_cols, F.col("line").alias("text"))
    )
    return ix.Relations(
        files(documents), symbols, chunks, lambda: edges(members), lambda parts: units(spark, sf_dir, parts),
        # the whole text, and its lines
        lambda: documents.agg(F.coalesce(2 * F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"])


def units(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame | None:
    """``Relations.units`` made within each document's row, without a join; None if a document's id comes more than once.

    Only the documents are dealt, into ``parts`` if given. A file's rows stay together,
    the whole text before its lines.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return None
    if parts is None:
        docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    else:
        docs = docs.select("doc_id", "text", "source", "lang").repartition(parts, "doc_id")
    said = F.filter(
        F.transform(F.split("text", "\n"), lambda s, i: F.struct((i + 1).alias("line_no"), s.alias("line"), F.regexp_extract_all(s, F.lit(_WORD), F.lit(0)).alias("ws"))),
        lambda x: F.size(x["ws"]) >= 2)
    shaped = paths(docs).select(
        "file_id", "text", "path", classify.role(F.col("path")).alias("role"), classify.language(F.col("path"), F.col("text")).alias("language"), said.alias("said"))
    shaped = shaped.withColumn("named", F.coalesce(F.transform("said", lambda x: F.struct(
        x["line_no"].alias("line_no"), x["line"].alias("line"), _kind(x["ws"]).alias("kind"), _name(x["ws"]).alias("name"))), F.array()))
    text = "string"
    seen = F.aggregate(
        "named", F.struct(F.lit(None).cast(text).alias("last"), F.array().cast(f"array<{text}>").alias("owners")),
        lambda acc, x: F.struct(
            F.when(x["kind"] == "class", x["name"]).otherwise(acc["last"]).alias("last"),
            F.concat(acc["owners"], F.array(acc["last"])).alias("owners")))
    shaped = shaped.drop("said").withColumn("owners", seen["owners"])
    module = F.struct(
        F.lit(0).alias("line_no"), F.col("text").alias("line"), F.lit("module").alias("kind"), F.col("path").alias("name"),
        F.col("path").alias("qualified_name"), F.lit(1).alias("start"), F.size(F.split("text", "\n")).alias("end"))

    def line(x: Column, i: Column) -> Column:
        owner = F.get("owners", i)
        member = (x["kind"] == "method") & owner.isNotNull()
        return F.struct(
            x["line_no"].alias("line_no"), x["line"].alias("line"), x["kind"].alias("kind"), x["name"].alias("name"),
            F.when(member, F.concat(owner, F.lit("."), x["name"])).otherwise(x["name"]).alias("qualified_name"),
            x["line_no"].alias("start"), x["line_no"].alias("end"))

    rows = shaped.select(
        "file_id", "path", "role", "language", F.explode(F.concat(F.array(module), F.transform("named", line))).alias("x"))
    number = packed(F.col("file_id"), F.col("x.line_no"))
    return rows.select(
        "file_id", number.alias("symbol_id"), number.alias("chunk_id"), F.col("x.qualified_name").alias("indexed_name"),
        F.col("x.line").alias("text"), "x.name", "x.qualified_name", "x.kind", F.col("x.start").alias("symbol_start"),
        F.col("x.end").alias("symbol_end"), "path", "role", "language")


def raw_edges(members: DataFrame) -> DataFrame:
    """Imports, conformances and calls before ids and targets are bound."""
    imports = members.groupBy("file_id", F.concat(F.lit("lib."), "first_word").alias("target_name")).agg(
        F.min("line_no").alias("line_no")
    ).select(
        "file_id", (F.col("file_id") * ORDINAL_SPAN).alias("source_symbol_id"), "target_name",
        F.lit("symbol_imports_module").alias("kind"), F.lit(0).alias("sort"), "line_no", F.lit(0).alias("idx"),
    )
    opening = members.select(
        "file_id", F.col("symbol_id").alias("source_symbol_id"), F.col("kind").alias("member_kind"), "line_no",
        F.posexplode("openings").alias("idx", "opening"),
    )
    left, right = F.get(F.split("opening", " "), F.lit(0)), F.get(F.split("opening", " "), F.lit(1))
    rest = opening.filter("member_kind != 'class' or idx = 0").select(
        "file_id", "source_symbol_id",
        F.when(F.col("member_kind") == "class", F.concat(_camel(left), _camel(right)))
        .otherwise(F.concat(F.lower(left), F.lit("_"), F.lower(right))).alias("target_name"),
        F.when(F.col("member_kind") == "class", "symbol_conforms_to").otherwise("symbol_calls_name").alias("kind"),
        F.lit(1).alias("sort"), "line_no", "idx",
    )
    return imports.unionByName(rest)


def edges(members: DataFrame) -> DataFrame:
    # read by five branches below, so it is written out once, without the lines
    members = cut_lineage(members.drop("line", "parent_symbol_id"))
    w = W.partitionBy("file_id").orderBy("sort", "line_no", "idx", "target_name")
    numbered = raw_edges(members).withColumn(
        "edge_id", packed(F.col("file_id"), F.row_number().over(w))
    )
    bound = ix.last_wins(members).select(
        "file_id", F.col("qualified_name").alias("target_name"), F.col("bound_id").alias("target_symbol_id")
    )
    in_file = numbered.join(bound, ["file_id", "target_name"], "left").select(
        "edge_id", "source_symbol_id", "target_symbol_id", "target_name", "kind", F.lit("name").alias("confidence")
    )
    return ix.resolve_conformance(in_file, members)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured requests from the benchmark items: distinctive words and line openings."""
    items = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    openings = F.transform(
        F.regexp_extract_all("text", F.lit(r"(?:^|[.!?]\s)([A-Za-z]{2,} [A-Za-z]{2,})"), F.lit(1)),
        lambda s: F.lower(F.replace(s, F.lit(" "), F.lit("_"))),
    )
    long_words = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}]{7,}"), F.lit(0)), F.lower)
    def strings(*values):
        return F.array(*[F.lit(v) for v in values])

    return items.select(
        i.alias("query_id"),
        F.array_distinct(F.concat(openings, long_words)).alias("terms"),
        F.when(i % 4 == 1, strings("function", "method")).alias("kinds"),
        F.when(i % 5 == 2, strings("source")).when(i % 7 == 3, strings("test")).alias("roles"),
        (i % 6 == 4).alias("exclude_support"),
        F.when(i % 3 == 0, strings("lib/src8", "src9/")).when(
            i % 3 == 1, F.array(F.concat(F.lit("src1_/"), i.cast("string"), F.lit("/the.py")), F.lit("src8"))
        ).alias("path_hints"),
        F.when(i % 9 == 0, "filter").otherwise("boost").alias("path_mode"),
        F.when(i % 8 == 5, F.array().cast("array<string>")).alias("expand"),
        F.lit(5).alias("limit"),
    ).withColumn("question", F.array_join("terms", " "))


_BUILT: dict[tuple[str, str], tuple[str, set[str]]] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> ix.Stored:
    """The index over ``sf_dir``; each table is built once per application, in the shared folder, when a query reads it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="codelode-index-")
        _BUILT[key] = f"{base}/{spark.sparkContext.applicationId}/index-{abs(hash(sf_dir))}", set()
    where, done = _BUILT[key]
    return ix.Stored(relations(spark, sf_dir), where, root=sf_dir, done=done, lasting=False)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten, row by row, as source code: a class with a method per line.

    English documents become Python, the others Kotlin. A method is named by
    its number and the line's first two words, calls its last word and carries
    the whole line as a comment; lines with fewer than two words are comments of
    the import. An opening round bracket in a comment would be read as a call and
    becomes a square one. Documents without a line of two words have the import
    alone and no class.
    """
    base = paths(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))))
    ws = lambda s: F.regexp_extract_all(s, F.lit(_WORD), F.lit(0))
    said = lambda s: F.replace(s, F.lit("("), F.lit("["))
    split = F.split("text", "\n")
    rest = said(F.array_join(F.filter(split, lambda s: F.size(ws(s)) < 2), " "))
    kept = F.filter(F.transform(split, lambda s: F.struct(s.alias("line"), ws(s).alias("w"))), lambda x: F.size(x["w"]) >= 2)
    head = F.transform(F.slice(kept, 1, 1), lambda x: F.concat(_camel(x["w"][0]), _camel(x["w"][1])))[0]
    name = lambda w, i: F.concat(F.lit("m"), i.cast("string"), F.lit("_"), F.lower(w[0]), F.lit("_"), F.lower(w[1]))
    called = lambda w: F.concat(F.lit("call_"), F.lower(F.element_at(w, -1)))
    python = F.concat(
        F.lit("import os  # "), rest, F.lit("\n\nclass "), head, F.lit("(Base"), F.col("file_id").cast("string"), F.lit("):\n"),
        F.array_join(F.transform(kept, lambda x, i: F.concat(
            F.lit("    def "), name(x["w"], i), F.lit("(self):  # "), said(x["line"]), F.lit("\n        return "), called(x["w"]),
            F.lit("(1)\n"))), "\n"),
    )
    kotlin = F.concat(
        F.lit("import os  // "), rest, F.lit("\n\nclass "), head, F.lit(" : Base"), F.col("file_id").cast("string"), F.lit(" {\n"),
        F.array_join(F.transform(kept, lambda x, i: F.concat(
            F.lit("    fun "), name(x["w"], i), F.lit("() {  // "), said(x["line"]), F.lit("\n        "), called(x["w"]),
            F.lit("(1)\n    }\n"))), "\n"), F.lit("}\n"),
    )
    py, empty = F.col("path").endswith(".py"), F.size(kept) == 0
    python = F.when(empty, F.concat(F.lit("import os  # "), rest, F.lit("\n"))).otherwise(python)
    kotlin = F.when(empty, F.concat(F.lit("import os  // "), rest, F.lit("\n"))).otherwise(kotlin)
    shaped = base.select(
        "file_id", F.regexp_replace("path", r"\.[a-z]+$", F.when(py, ".py").otherwise(".kt")).alias("path"),
        F.when(py, python).otherwise(kotlin).alias("text"),
    )
    # extraction reads the files several times and tests their language on
    # every line, so text and class are written out once
    return cut_lineage(shaped.select(
        "file_id", "path", "text", F.sha2("text", 256).alias("hash"),
        classify.language(F.col("path"), F.col("text")).alias("language"), classify.role(F.col("path")).alias("role"),
    ))


#: Code around each text line, by language: file head, method, file end. Each method holds the line, brackets and
#: declarations in a comment and in a string over several lines, and has its parameters on lines of their own.
TRAPS = {
    "python": ("py", "import os\n\nclass {c}:\n", """    @wrap
    def {m}(
        self,
        a="{{",
    ):
        \"\"\"{s} (
class Fake:
    def fake(self):
        \"\"\"
        return call(a)

""", ""),
    "java": ("java", "import java.util.List;\n\npublic class {c} {{\n", """    /* {s} {{
    class Fake {{
    */
    public int {m}(
        int a,
        int b
    ) {{
        String s = "{s} {{";
        // class Fake {{
        return call(a);
    }}

""", "}}\n"),
    "typescript": ("ts", 'import x from "lib";\n\nexport class {c} {{\n', """  /* {s} {{
  class Fake {{
  */
  {m}(
    a: string,
    b = "}}"
  ): void {{
    const t = `class Fake {{
      {s} }}}}`;
    call(t);
  }}

""", "}}\n"),
    "go": ("go", "package p\n\ntype {c} struct {{\n}}\n", """/* {s} {{
func Fake() {{
*/
func (s *{c}) {m}(
	a int,
	b string,
) int {{
	t := `func Fake() {{
{s} `
	return call(t)
}}

""", ""),
    "rust": ("rs", "use std::io;\npub struct {c} {{\n}}\nimpl {c} {{\n", """    /* {s} {{
    fn fake() {{
    */
    pub fn {m}(
        &self,
        a: &'static str,
    ) -> i32 {{
        let t = r#"fn fake() {{
{s} "#;
        call(t)
    }}

""", "}}\n"),
}


def _filled(template: str, **values: Column) -> Column:
    """The template with columns in place of its fields; doubled braces stand for themselves."""
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [values[field]] if field else []
    return F.concat(*parts) if parts else F.lit("")


def trap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source file in one of five languages, with a method for each of its lines (see ``TRAPS``).

    The language goes by the id's remainder. Quotes, backslashes and stars of a line
    become other marks, so that it ends no comment or string.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text"))
    number, name = F.pmod("file_id", F.lit(len(TRAPS))), F.concat(F.lit("C"), F.col("file_id").cast("string"))
    said = lambda s: F.translate(s, "\"\\`*\r", "'/'+ ")
    first = lambda s: F.lower(F.regexp_extract(s, "[A-Za-z]+", 0))
    method = lambda s, i: F.concat(F.lit("m"), i.cast("string"), F.when(first(s) == "", F.lit("")).otherwise(F.concat(F.lit("_"), first(s))))

    def methods(template: str) -> Column:
        return F.array_join(F.transform(F.split("text", "\n"), lambda s, i: _filled(template, c=name, m=method(s, i), s=said(s))), "")

    chosen = None
    for i, (language, (ending, head, body, end)) in enumerate(TRAPS.items()):
        one = F.struct(
            F.lit(language).alias("language"), F.concat(F.lit("src/"), name, F.lit(f".{ending}")).alias("path"),
            F.concat(_filled(head, c=name), methods(body), _filled(end)).alias("text"),
        )
        chosen = F.when(number == i, one) if chosen is None else chosen.when(number == i, one)
    return cut_lineage(docs.select("file_id", chosen.alias("x")).select(
        "file_id", "x.path", "x.text", F.sha2("x.text", 256).alias("hash"), "x.language", F.lit("source").alias("role")))
