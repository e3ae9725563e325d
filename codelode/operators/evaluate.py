"""Evaluation: retrieval quality, grep-style baselines, workflows, comparisons, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.operators import fulltext as ft
from codelode.operators.related import holding

BASELINE_LIMIT = 5
PATH_POINTS = 3
SLOTS = 256


def group_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upper median, minimum, maximum and spread per group.

    Equal values are counted first. Values fall into slots that keep their
    order; the slot that holds the median follows from the slots' counts, and
    only its values are ranked, so a large group is never sorted in one task.
    """
    v = F.col(value).cast("double")
    slot = F.floor(F.signum(v) * F.log2(F.lit(1.0) + F.abs(v)) * SLOTS).alias("slot")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select(*keys, value, "c", slot)
    slots = counts.groupBy(*keys, "slot").agg(F.sum("c").alias("c"), F.min(value).alias("low"), F.max(value).alias("high"))
    w = W.partitionBy(*keys)
    upto = F.sum("c").over(w.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    placed = slots.select(
        *keys, "slot", (upto - F.col("c")).alias("before"), upto.alias("upto"), F.sum("c").over(w).alias("runs"),
        F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"),
    ).withColumn("rank", F.floor(F.col("runs") / 2) + 1).filter("before < rank and rank <= upto")
    inner = F.sum("c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    ranked = counts.join(placed, [*keys, "slot"]).withColumn("inner", inner).filter("inner >= rank")
    return ranked.groupBy(*keys, "low", "high", "runs").agg(F.min(value).alias("median")).select(
        *keys, "low", "median", "high", "runs", (F.col("high") - F.col("low")).alias("spread")
    )


def expected_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per question: first position of an expected symbol, of an expected file, and files found.

    ``results``: query_id, position, file, symbol. ``expected``: query_id,
    kind ('file' or 'symbol') and value, one row per expectation. A symbol
    matches by name or by a dotted ending.
    """
    files = expected.filter("kind = 'file'").select("query_id", F.col("value").alias("file"))
    found = results.join(files, ["query_id", "file"]).groupBy("query_id").agg(
        F.min("position").alias("file_position"), F.countDistinct("file").alias("files_found")
    )
    parts = F.split("symbol", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    symbols = expected.filter("kind = 'symbol'").select("query_id", F.col("value").alias("ending"))
    named = (
        results.select("query_id", "position", F.explode(F.array_distinct(endings)).alias("ending"))
        .join(symbols, ["query_id", "ending"]).groupBy("query_id").agg(F.min("position").alias("symbol_position"))
    )
    wanted = expected.groupBy("query_id").agg(F.sum(F.when(F.col("kind") == "file", 1).otherwise(0)).alias("files_wanted"))
    return wanted.join(found, "query_id", "left").join(named, "query_id", "left").withColumn(
        "files_found", F.coalesce("files_found", F.lit(0)))


def retrieval_metrics(hits: DataFrame) -> DataFrame:
    """Hit@1, Hit@5, file Hit@5, mean reciprocal rank, partial file rate."""
    def rate(test: Column) -> Column:
        return F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 4)

    return hits.agg(
        F.count(F.lit(1)).alias("questions"),
        rate(F.col("symbol_position") == 1).alias("symbol_hit_1"),
        rate(F.col("symbol_position") <= 5).alias("symbol_hit_5"),
        rate(F.col("file_position") == 1).alias("file_hit_1"),
        rate(F.col("file_position") <= 5).alias("file_hit_5"),
        F.round(F.avg(F.coalesce(1 / F.col("file_position"), F.lit(0.0))), 4).alias("file_mrr"),
        rate((F.col("files_found") > 0) & (F.col("files_found") < F.col("files_wanted"))).alias("partial_files"),
    )


def term_occurrences(terms: DataFrame, hay: DataFrame, keys: list[str]) -> DataFrame:
    """(term, keys, hits) for every text that holds a term as a substring; only those texts are counted in."""
    return holding(terms, hay, keys).join(hay, keys).filter(F.col("hay").contains(F.col("term"))).select(
        "term", *keys, tx.occurrences(F.col("hay"), F.col("term")).alias("hits")
    )


def file_baseline(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Grep-style ranking: occurrences of each term plus three when the path has it.

    ``questions``: query_id, term. ``files``: path, text.
    """
    body = term_occurrences(questions, files.select("path", tx.normalize_loose(F.col("text")).alias("hay")), ["path"])
    named = term_occurrences(questions, files.select("path", tx.normalize_loose(F.col("path")).alias("hay")), ["path"])
    points = body.select("term", "path", F.col("hits").alias("points")).unionByName(
        named.select("term", "path", F.lit(PATH_POINTS).cast("long").alias("points"))
    ).groupBy("term", "path").agg(F.sum("points").alias("points"))
    scored = questions.distinct().join(points, "term").groupBy("query_id", "path").agg(F.sum("points").alias("score"))
    return ft.best(scored, ["query_id"], [F.col("score").desc(), F.col("path")], BASELINE_LIMIT)


def line_baseline(questions: DataFrame, files: DataFrame) -> DataFrame:
    """Ranking by matching lines: each line counts its distinct terms."""
    lines = files.select("path", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line")).select(
        "path", "line_no", tx.normalize_loose(F.col("line")).alias("hay"))
    hits = term_occurrences(questions, lines, ["path", "line_no"])
    per_file = questions.distinct().join(hits, "term").groupBy("query_id", "path").agg(
        F.count(F.lit(1)).alias("score"), F.countDistinct("line_no").alias("matched_lines")
    )
    return ft.best(per_file, ["query_id"], [F.col("score").desc(), F.col("path")], BASELINE_LIMIT)


def workflow_summary(steps: DataFrame, expected: DataFrame) -> DataFrame:
    """First useful step, completion step and the tokens spent until each.

    ``steps``: case_id, step (1-based), tokens, found (array). ``expected``:
    case_id, wanted (array). A case is complete once all wanted values were
    found in some step so far.
    """
    first_seen = (
        steps.select("case_id", "step", F.explode("found").alias("value"))
        .join(expected.select("case_id", F.explode(F.array_distinct("wanted")).alias("value")), ["case_id", "value"])
        .groupBy("case_id", "value").agg(F.min("step").alias("seen"))
        .groupBy("case_id").agg(F.min("seen").alias("first_useful"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("n_found"))
    )
    running = steps.withColumn(
        "spent", F.sum("tokens").over(W.partitionBy("case_id").orderBy("step").rowsBetween(W.unboundedPreceding, 0)))
    totals = (
        running.join(first_seen.select("case_id", "first_useful", "last_seen"), "case_id", "left").groupBy("case_id").agg(
            F.count(F.lit(1)).alias("commands"), F.max("spent").alias("total_tokens"),
            F.max(F.when(F.col("step") == F.col("first_useful"), F.col("spent"))).alias("first_useful_tokens"),
            F.max(F.when(F.col("step") == F.col("last_seen"), F.col("spent"))).alias("tokens_at_last"),
        )
    )
    wanted = expected.select("case_id", F.size(F.array_distinct("wanted")).alias("n_wanted"))
    done = F.coalesce(F.col("n_found") == F.col("n_wanted"), F.lit(False)) | (F.col("n_wanted") == 0)
    return (
        wanted.join(first_seen, "case_id", "left").join(totals, "case_id", "left").select(
            "case_id", "n_wanted", F.coalesce("n_found", F.lit(0)).alias("n_found"), done.alias("complete"), "commands",
            "total_tokens", "first_useful", "first_useful_tokens",
            F.when(done, F.col("last_seen")).alias("completed_at"),
            F.when(done, F.coalesce("tokens_at_last", F.lit(0))).alias("completion_tokens"),
        )
    )


def winners(summaries: DataFrame, left: str, right: str) -> DataFrame:
    """Per case the workflow that completes, then the one with fewer tokens, then fewer commands."""
    cols = ["complete", "completion_tokens", "total_tokens", "commands"]
    a = summaries.filter(F.col("workflow") == left).select("case_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = summaries.filter(F.col("workflow") == right).select("case_id", *[F.col(c).alias(f"b_{c}") for c in cols])

    def less(x: Column, y: Column, otherwise) -> Column:
        return F.when(x < y, left).when(y < x, right).otherwise(otherwise)

    c = F.col
    by_commands = less(c("a_commands"), c("b_commands"), "tie")
    return a.join(b, "case_id").select(
        "case_id",
        F.when(c("a_complete") & ~c("b_complete"), left).when(~c("a_complete") & c("b_complete"), right)
        .when(c("a_complete"), less(c("a_completion_tokens"), c("b_completion_tokens"), by_commands))
        .otherwise(less(c("a_total_tokens"), c("b_total_tokens"), by_commands)).alias("winner"),
    )


def weighted_means(df: DataFrame, weight: str, values: list[str]) -> DataFrame:
    """Means weighted by case count, to four places."""
    return df.agg(
        F.sum(weight).alias("cases"),
        *[F.round(F.sum(F.col(v) * F.col(weight)) / F.sum(weight), 4).alias(v) for v in values],
    )


def compare_artifacts(
    baseline: DataFrame, current: DataFrame, key: str, not_lower: list[str], budgets: dict[str, float]
) -> DataFrame:
    """Regressions of a current run against a baseline, one row each.

    A missing row, a lower value of a ``not_lower`` metric, or a value over
    ``baseline * (1 + budget)`` counts.
    """
    cur = current.select(key, F.lit(True).alias("_present"), *[F.col(m).alias(f"c_{m}") for m in [*not_lower, *budgets]])
    joined = baseline.join(cur, key, "left")
    missing = F.col("_present").isNull()
    checks = [F.when(missing, F.struct(F.lit("missing").alias("metric"), F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after")))]
    for metric in not_lower:
        checks.append(F.when(F.col(f"c_{metric}") < F.col(metric), F.struct(
            F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("before"), F.col(f"c_{metric}").cast("double").alias("after"))))
    for metric, slack in budgets.items():
        checks.append(F.when(F.col(f"c_{metric}") > F.col(metric) * (1 + slack), F.struct(
            F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("before"), F.col(f"c_{metric}").cast("double").alias("after"))))
    return joined.select(key, F.explode(F.array_compact(F.array(*checks))).alias("r")).select(
        key, F.col("r.metric").alias("metric"), F.col("r.before").alias("before"), F.col("r.after").alias("after")
    )


def condition_summary(reviews: DataFrame) -> DataFrame:
    """Per condition: outcomes, mean quality, median cost, all failure modes with their counts.

    ``reviews``: condition, success ('pass', 'partial', 'fail'), quality, tokens, failure_mode.
    """
    def n(outcome: str) -> Column:
        return F.sum(F.when(F.col("success") == outcome, 1).otherwise(0))

    base = reviews.groupBy("condition").agg(
        F.count(F.lit(1)).alias("reviews"), n("pass").alias("passed"), n("partial").alias("partial"), n("fail").alias("failed"),
        F.round(F.avg("quality"), 4).alias("mean_quality"),
    )
    medians = group_medians(reviews, ["condition"], "tokens").select("condition", F.col("median").alias("median_tokens"))
    modes = reviews.filter("failure_mode is not null").groupBy("condition", "failure_mode").agg(F.count(F.lit(1)).alias("n"))
    # one entry for each distinct mode
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col("failure_mode").alias("mode"))))
    histogram = modes.groupBy("condition").agg(listed.alias("listed")).select(
        "condition", F.transform("listed", lambda x: F.struct(x["mode"].alias("mode"), (-x["order"]).alias("n"))).alias("failures")
    )
    return base.join(medians, "condition", "left").join(histogram, "condition", "left")


def mention_rates(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of expected values an answer mentions, per case.

    ``answers``: case_id, text. ``expected``: case_id, value.
    """
    joined = expected.join(answers, "case_id", "left")
    hit = F.coalesce(F.lower("text").contains(F.lower("value")), F.lit(False))
    return joined.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("expected"), F.sum(hit.cast("int")).alias("mentioned"),
    ).withColumn("rate", F.round(F.col("mentioned") / F.col("expected"), 4))


def leaked_targets(cases: DataFrame) -> DataFrame:
    """Cases whose queries already name what they should find.

    ``cases``: case_id, queries (array), targets (array).
    """
    said = F.transform("queries", tx.normalize_target)
    leaks = F.filter(
        "targets",
        lambda t: (F.length(tx.normalize_target(t)) > 0) & F.exists(said, lambda q: q.contains(tx.normalize_target(t))),
    )
    return cases.select("case_id", F.explode(leaks).alias("leaked"))


def trace_report(events: DataFrame) -> DataFrame:
    """Counts per event type and outcome with the time span in milliseconds.

    ``events``: session, type, outcome, ts (timestamp).
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.groupBy("session").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum((F.col("type") == "index-query").cast("int")).alias("queries"),
        F.sum((F.col("type") == "search-fallback").cast("int")).alias("fallbacks"),
        F.sum((F.col("type") == "code-change").cast("int")).alias("changes"),
        F.sum((F.col("type") == "verification").cast("int")).alias("verifications"),
        F.sum((F.col("type") == "lesson").cast("int")).alias("lessons"),
        F.sum((F.col("outcome") == "useful").cast("int")).alias("useful"),
        (F.max(ms) - F.min(ms)).alias("duration_ms"),
        (F.min(F.when(F.col("outcome") == "useful", ms)) - F.min(ms)).alias("first_useful_ms"),
    )
