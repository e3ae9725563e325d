"""JSON and JSON-lines inputs and outputs: question sets, cases, reviews, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.operators.navigation import METRICS, SUITE

AGENT_QUERY = (
    "struct<terms:array<string>,symbolKinds:array<string>,pathHints:array<string>,pathMode:string,"
    "roles:array<string>,excludeSupportCode:boolean,expand:array<string>,limit:int>"
)
QUESTIONS = f"id string, question string, agentQuery {AGENT_QUERY}, expected struct<files:array<string>,symbols:array<string>>"
NAVIGATION = (
    f"id string, task string, kind string, indexQueries array<{AGENT_QUERY}>, searchQueries array<array<string>>, "
    "expected struct<files:array<string>,symbols:array<string>,requiredFiles:array<string>,requiredSymbols:array<string>>"
)
REVIEWS = (
    "taskId string, condition string, success string, quality int, firstUsefulFile string, firstUsefulTool string, "
    "specialToolHelped string, tests string, failureMode string, notes string"
)
TRACE = "type string, timestamp string, outcome string, command string, note string, query string, _corrupt string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(path, multiLine=True)


def read_navigation(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Navigation cases; ``names`` gives the field names that other files use for ours."""
    names = names or {}
    schema = T.StructType.fromDDL(NAVIGATION)
    foreign = T.StructType([T.StructField(names.get(f.name, f.name), f.dataType) for f in schema])
    return spark.read.schema(foreign).json(path, multiLine=True).toDF(*schema.names)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REVIEWS).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "review.json").json(path, multiLine=True)


def question_requests(questions: DataFrame) -> DataFrame:
    """Requests and expectations of a question set; plain questions become terms."""
    q = F.col("agentQuery")
    return questions.select(
        F.xxhash64("id").alias("query_id"), "id",
        F.coalesce(q["terms"], F.split("question", r"\s+")).alias("terms"),
        q["symbolKinds"].alias("kinds"), q["roles"].alias("roles"),
        F.coalesce(q["excludeSupportCode"], F.lit(False)).alias("exclude_support"),
        q["pathHints"].alias("path_hints"), q["pathMode"].alias("path_mode"), q["expand"].alias("expand"),
        F.coalesce(q["limit"], F.lit(5)).alias("limit"), "expected",
    )


def expectations(requests: DataFrame) -> DataFrame:
    """One row per expected file or symbol."""
    return requests.select("query_id", F.explode("expected.files").alias("value")).withColumn("kind", F.lit("file")).unionByName(
        requests.select("query_id", F.explode("expected.symbols").alias("value")).withColumn("kind", F.lit("symbol")))


def read_trace(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Events of a JSON-lines trace. Lines that do not parse, and empty traces, are errors.

    ``types`` maps the event types of other tools to ours: index-query,
    search-fallback, code-change, verification, lesson.
    """
    raw = spark.read.schema(TRACE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    checked = raw.withColumn(
        "type", F.when(F.col("_corrupt").isNotNull(), F.raise_error(F.concat(F.lit("bad trace line: "), "_corrupt"))).otherwise(F.col("type"))
    )
    if types:
        checked = checked.replace(types, subset=["type"])
    return checked.drop("_corrupt").withColumn("ts", F.to_timestamp("timestamp"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Free answers to the questions of a set, by the ids that ``question_requests`` gives them."""
    answers = spark.read.schema("id string, text string").json(path, multiLine=True)
    return answers.select(F.xxhash64("id").alias("query_id"), "text")


def read_suite(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Metrics of a run, an object for each repository and one without a name for the suite.

    ``names`` gives the field names that other files use for ours; metrics that a file lacks are null.
    """
    names = names or {}
    fields = ["name", *METRICS]
    foreign = T.StructType([T.StructField(names.get(f, f), T.StringType() if f == "name" else T.DoubleType()) for f in fields])
    return spark.read.schema(foreign).json(path, multiLine=True).toDF(*fields).fillna(SUITE, ["name"])


def append_trace(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
