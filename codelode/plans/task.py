"""Task presets: which searches answer a bug fix, a feature, an explanation, a test hunt."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from codelode.functions.intent import DECISION_WORDS, DEFAULT_WORDS
from codelode.operators.clusters import file_clusters
from codelode.operators.related import related_tests
from codelode.operators.source_tests import source_tests
from codelode.plans.search import search
from codelode.schemas import QUERIES

KINDS = ("bugfix", "feature", "explain", "find-tests", "source-to-tests")
# Symbol kinds a preset looks at.
IMPLEMENTATION_KINDS = ("function", "method", "class")
API_KINDS = ("class", "method", "function", "typealias")


@dataclass(frozen=True)
class Step:
    kind: str  # file-clusters, query, source-tests or related-tests
    purpose: str
    roles: tuple[str, ...] = ("source",)
    kinds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Task:
    terms: tuple[str, ...]
    kinds: tuple[str, ...] = ()
    path_hints: tuple[str, ...] = ()
    path_mode: str = "boost"
    source: str | None = None
    symbol: str | None = None
    limit: int = 5
    test_limit: int = 2
    extra: dict = field(default_factory=dict)


def expand_vocabulary(terms: tuple[str, ...]) -> tuple[str, ...]:
    """Questions about a default's behaviour are answered by its resolver."""
    words = {w for t in terms for w in t.lower().split()}
    if words & set(DEFAULT_WORDS) and words & set(DECISION_WORDS):
        return tuple(dict.fromkeys([*terms, "resolve", "decision"]))
    return terms


def plan_task(kind: str, task: Task) -> list[Step]:
    if kind not in KINDS:
        raise ValueError(f"unknown task kind {kind}; choose one of {', '.join(KINDS)}")
    if kind == "source-to-tests":
        if not task.source:
            raise ValueError("task source-to-tests requires --source <file>")
        return [Step("related-tests", "direct-related-tests")]
    if not task.terms:
        raise ValueError(f"task {kind} requires a task description or --term values")
    clusters, bundle = Step("file-clusters", "source-map"), Step("source-tests", "related-tests")
    return {
        "bugfix": [clusters, Step("query", "implementation-context", kinds=task.kinds or IMPLEMENTATION_KINDS), bundle],
        "feature": [
            clusters, Step("query", "nearby-apis", kinds=task.kinds or API_KINDS),
            Step("source-tests", "likely-tests"), Step("file-clusters", "examples", ("test", "example")),
        ],
        "explain": [clusters, Step("query", "core-symbols", kinds=task.kinds)],
        "find-tests": [Step("source-tests", "source-test-relations")],
    }[kind]


def request(spark: SparkSession, task: Task, step: Step) -> DataFrame:
    row = (0, list(task.terms), list(step.kinds) or None, list(step.roles), False,
           list(task.path_hints) or None, task.path_mode, None, task.limit)
    return spark.createDataFrame([row], QUERIES)


def run_task(index, kind: str, task: Task) -> dict[str, DataFrame]:
    """One lazily built result per step, keyed by purpose."""
    spark = index.files.sparkSession
    if kind == "bugfix":
        task = Task(**{**task.__dict__, "terms": expand_vocabulary(task.terms)})
    results = {}
    for step in plan_task(kind, task):
        if step.kind == "related-tests":
            sources = spark.createDataFrame(
                [(0, task.source, task.symbol, list(task.terms), task.limit)],
                "source_id long, source_file string, symbol string, terms array<string>, limit int")
            results[step.purpose] = related_tests(index, sources)
            continue
        queries = request(spark, task, step)
        results[step.purpose] = {
            "file-clusters": lambda q: file_clusters(index, q),
            "query": lambda q: search(index, q, "hybrid"),
            "source-tests": lambda q: source_tests(index, q, test_limit=task.test_limit),
        }[step.kind](queries)
    return results


def guide(results: dict[str, list]) -> dict:
    """What to open first, from the collected top rows of each step."""
    bundles = next((rows for name, rows in results.items() if "tests" in name or name == "source-test-relations"), [])
    maps, found = results.get("source-map", []), next((r for n, r in results.items() if n in ("implementation-context", "nearby-apis", "core-symbols")), [])
    first = (maps or bundles or found or [None])[0]
    if first is None:
        return {"action": "broaden-search", "confidence": "low", "open_first": None, "follow_up": ["fewer or other terms"]}
    agrees = bool(found) and found[0]["file"] == first["file"]
    tested = any(b["file"] == first["file"] and b.asDict().get("tests") for b in bundles)
    return {
        "action": "open-source", "open_first": first["file"],
        "confidence": "high" if agrees and tested else "medium" if agrees or tested else "low",
        "follow_up": [t["file"] for b in bundles[:1] for t in (b.asDict().get("tests") or [])],
    }
