"""Command line: python -m codelode.cli <command> ..."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import evaluate as ev
from codelode.operators import extract, index as ix
from codelode.operators import navigation as nv
from codelode.operators.clusters import file_clusters
from codelode.operators.related import related_tests
from codelode.operators.source_tests import source_tests
from codelode.plans import search as plan_search
from codelode.plans import task as plan_task
from codelode.schemas import KINDS, MODES, QUERIES
from codelode.functions.classify import ROLES
from codelode.session import local_session
from codelode.sources import documents, scan


def _list(values: list[str] | None) -> list[str]:
    return [p.strip() for v in values or [] for p in v.split(",") if p.strip()]


def _checked(values: list[str], allowed: tuple[str, ...], what: str) -> list[str] | None:
    bad = [v for v in values if v not in allowed]
    if bad:
        raise ValueError(f"unknown {what} {', '.join(bad)}; choose from {', '.join(allowed)}")
    return values or None


def _index_path(args) -> str:
    return args.index_path or os.path.join(os.path.abspath(args.target), ".codelode", "index")


def build(spark, args) -> None:
    where = _index_path(args)
    files = scan.read_tree(spark, os.path.abspath(args.target), args.source_only)
    numbered = ix.file_ordinals(files)
    numbered.write.mode("overwrite").parquet(f"{where}/sources")
    stored = spark.read.parquet(f"{where}/sources")
    ix.write_index(extract.extract(stored), where, os.path.abspath(args.target),
                   "source-only" if args.source_only else "all-files", datetime.datetime.now(datetime.UTC).isoformat())
    idx = ix.open_index(spark, where)
    print(json.dumps({r["relation"]: r["row_count"] for r in ix.relation_counts(idx).collect()}))


def _request(spark, args) -> DataFrame:
    if args.agent_query:
        q = json.loads(args.agent_query)
        row = (0, q["terms"], _checked(q.get("symbolKinds") or [], KINDS, "kind"), _checked(q.get("roles") or [], ROLES, "role"),
               bool(q.get("excludeSupportCode")), q.get("pathHints"), q.get("pathMode"), q.get("expand"), q.get("limit") or args.limit)
    else:
        terms = _list(args.term) or (args.question or "").split()
        if not terms:
            raise ValueError("give a question or at least one --term")
        if args.role and args.exclude_support_code:
            raise ValueError("--role and --exclude-support-code exclude each other")
        row = (0, terms, _checked(_list(args.kind), KINDS, "kind"), _checked(_list(args.role), ROLES, "role"),
               args.exclude_support_code, _list(args.path_hint) or None, args.path_mode, None, args.limit)
    return spark.createDataFrame([row], QUERIES)


def _print(df: DataFrame, order: str = "position") -> None:
    """Rows as JSON lines; results are cut to the request's limit before."""
    for row in df.orderBy(order).toJSON().toLocalIterator():
        print(row)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codelode")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, request: bool = False):
        p = sub.add_parser(name)
        p.add_argument("--target", "--repo", default=".")
        p.add_argument("--index-path", "--index", "--db")
        p.add_argument("--limit", type=int, default=8 if name == "file-clusters" else 5)
        if request:
            p.add_argument("question", nargs="?")
            p.add_argument("--agent-query")
            for flag in ("--term", "--kind", "--role", "--path-hint"):
                p.add_argument(flag, action="append")
            p.add_argument("--path-mode", choices=("boost", "filter"), default="boost")
            p.add_argument("--exclude-support-code", action="store_true")
        return p

    command("index").add_argument("--source-only", action="store_true")
    command("query", True).add_argument("--mode", choices=MODES, default="symbol")
    command("file-clusters", True)
    command("source-tests", True).add_argument("--test-limit", type=int, default=2)
    rt = command("related-tests")
    rt.add_argument("source")
    rt.add_argument("--symbol")
    rt.add_argument("--term", action="append")
    t = command("task", True)
    t.add_argument("--preset", choices=plan_task.KINDS, required=True)
    t.add_argument("--source")
    t.add_argument("--symbol")
    b = command("benchmark")
    b.add_argument("questions")
    b.add_argument("--mode", choices=MODES, default="hybrid")
    a = command("agent-eval")
    a.add_argument("questions")
    a.add_argument("--answers")
    a.add_argument("--mode", choices=MODES, default="hybrid")
    r = command("nav-compare")
    r.add_argument("baseline")
    r.add_argument("current")
    for flag in ("--token-increase", "--token-increase-percent"):
        r.add_argument(flag, type=float, default=0.0)
    for flag in ("--latency-increase-ms", "--latency-increase-percent"):
        r.add_argument(flag, type=float)
    r.add_argument("--require-dominance", action="store_true")
    r.add_argument("--require-tool-use", action="store_true")
    n = command("trace-note")
    n.add_argument("trace")
    n.add_argument("note")
    command("trace-report").add_argument("trace")
    s = command("autonomous-summary")
    s.add_argument("reviews")
    args = parser.parse_args(argv)

    spark = local_session()
    try:
        if args.command == "index":
            build(spark, args)
            return 0
        if args.command == "trace-note":
            now = datetime.datetime.now(datetime.UTC).isoformat()
            documents.append_trace(spark.createDataFrame([("lesson", now, args.note)], "type string, timestamp string, note string"), args.trace)
            return 0
        if args.command == "trace-report":
            events = documents.read_trace(spark, args.trace).withColumn("session", F.lit("trace"))
            if events.isEmpty():
                raise ValueError("the trace holds no events")
            _print(ev.trace_report(events), "session")
            return 0
        if args.command == "nav-compare":
            budgets = nv.Budgets(args.token_increase, args.token_increase_percent, args.latency_increase_ms,
                                 args.latency_increase_percent, args.require_dominance, args.require_tool_use)
            worse = nv.suite_regressions(documents.read_suite(spark, args.baseline), documents.read_suite(spark, args.current), budgets).cache()
            _print(worse, "name")
            return int(not worse.isEmpty())
        if args.command == "autonomous-summary":
            reviews = documents.read_reviews(spark, args.reviews).select(
                "condition", "success", "quality", F.lit(None).cast("long").alias("tokens"), F.col("failureMode").alias("failure_mode"))
            _print(ev.condition_summary(reviews), "condition")
            return 0
        index = ix.open_index(spark, _index_path(args))
        asked = _list(getattr(args, "role", None))
        needs = args.command in ("related-tests", "source-tests")
        for warning in ix.index_warnings(index.metadata, os.path.abspath(args.target), asked, needs):
            print(json.dumps(warning), file=sys.stderr)
        if args.command == "query":
            _print(plan_search.search(index, _request(spark, args), args.mode))
        elif args.command == "file-clusters":
            _print(file_clusters(index, _request(spark, args)))
        elif args.command == "source-tests":
            _print(source_tests(index, _request(spark, args), test_limit=args.test_limit))
        elif args.command == "related-tests":
            row = (0, args.source, args.symbol, _list(args.term), args.limit)
            sources = spark.createDataFrame([row], "source_id long, source_file string, symbol string, terms array<string>, limit int")
            matches = related_tests(index, sources).cache()
            declared = nv.test_symbols(matches, sources, index.files, index.symbols).drop("n_symbols")
            _print(matches.join(declared, ["source_id", "file"], "left"))
        elif args.command == "task":
            words = tuple(_list(args.term) or (args.question or "").split())
            task = plan_task.Task(words, tuple(_list(args.kind)), tuple(_list(args.path_hint)), args.path_mode, args.source, args.symbol, args.limit)
            rows = {}
            for purpose, df in plan_task.run_task(index, args.preset, task).items():
                rows[purpose] = df.orderBy("position").collect()
                for row in rows[purpose]:
                    print(json.dumps({"step": purpose, **row.asDict(True)}, default=str))
            print(json.dumps({"guide": plan_task.guide(rows)}))
        elif args.command == "agent-eval":
            requests = documents.question_requests(documents.read_questions(spark, args.questions))
            expected = documents.expectations(requests)
            hits = ev.expected_hits(plan_search.search(index, requests, args.mode), expected)
            said = nv.mentions(documents.read_answers(spark, args.answers), expected) if args.answers else None
            _print(requests.select("query_id", "id").join(nv.answer_winners(hits, said), "query_id").drop("query_id"), "id")
        elif args.command == "benchmark":
            requests = documents.question_requests(documents.read_questions(spark, args.questions))
            results = plan_search.search(index, requests, args.mode)
            _print(ev.retrieval_metrics(ev.expected_hits(results, documents.expectations(requests))), "questions")
    except (ValueError, FileNotFoundError, NotADirectoryError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
