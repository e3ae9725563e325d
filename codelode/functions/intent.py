"""Intent rules: question gates and candidate scores as Column expressions.

A rule fires when its gate holds on the question and its score on the row is
positive; it then offers ``12 + score``. The general rules are built in.
Vocabulary tied to one code base is data: ``LiteralRule`` values, built in for
the small general set below and loaded from JSON for anything else.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.functions.features import CONNECTORS, _any_loose, action_match, has_any, strings

RULE_BOOST = 12

# Vocabularies of the general rules.
OWNER_ACTIONS = ("send", "receive", "parse", "validate", "open", "close")
PUBLIC_API_WORDS = ("validate", "dump", "json", "schema", "rebuild", "parse", "load", "save")
DUMP_WORDS = ("serialize", "serializes", "serialized", "serializing")
FACTORY_ACTIONS = ("create", "build", "generate")
FACTORY_QUESTION = ("create", "creates", "build", "builds", "generate", "generates")
DEFAULT_WORDS = ("default", "defaults")
DECISION_WORDS = ("disable", "disabled", "enable", "enabled", "decide", "decides", "decision", "behavior", "signal")
RESOLVER_WORDS = ("resolve", "resolver", "get", "choose", "determine", "compute", "select")
DECISION_GENERIC = (
    *DEFAULT_WORDS, *DECISION_WORDS, "should", "from", "with", "without", "true", "false", "none",
    "null", "env", "environment", "variable", *RESOLVER_WORDS,
)
DOMAIN_MODULES = ("converter", "validator", "setter", "serializer", "parser", "reader", "writer", "filter", "compiler")
DOMAIN_ALIASES = {
    "validator": ("validate",), "setter": ("setattr", "on", "set"), "parser": ("parse", "parser"),
    "reader": ("parse", "parser", "read"), "writer": ("write", "writer"),
}
READER_WORDS = ("body", "chunked", "header", "headers", "line", "lines", "message", "request", "response")
LIFECYCLE_ACTIONS = (
    "start", "stop", "suspend", "resume", "read", "write", "open", "close", "set", "unset", "undo",
    "reset", "create", "cleanup", "clean", "remove", "delete",
)
API_WORDS = ("function", "method", "class", "defined", "definition", "convenience", "api")
SERIALIZE_ACTIONS = ("convert", "conversion", "serialize", "serializes", "serialized", "serializing")
SERIALIZE_OBJECTS = ("instance", "instances", "object", "objects", "model")
SERIALIZE_OUTPUTS = ("dict", "dictionary", "dictionaries", "tuple", "tuples", "json", "jsonable")
ENTRY_SEEDS = ("main", "_main", "__main__", "cli", "console")


@dataclass(frozen=True)
class LiteralRule:
    """A rule given as data.

    ``all_of`` lists groups of question words; each group needs one hit.
    ``tests`` are (field, operator, literal, points[, question word]) with field
    name, symbol, text or path and operator ``is``, ``has`` or ``ends``.
    ``seeds`` are names scanned for candidates when the gate holds.
    """

    reason: str
    all_of: tuple[tuple[str, ...], ...]
    tests: tuple[tuple, ...]
    none_of: tuple[str, ...] = ()
    seeds: tuple[str, ...] = field(default=())

    def gate(self, tokens: Column) -> Column:
        ok = F.lit(True)
        for group in self.all_of:
            ok = ok & has_any(tokens, group)
        return ok & ~has_any(tokens, self.none_of) if self.none_of else ok

    def score(self, tokens: Column) -> Column:
        fields = {"name": F.col("name"), "symbol": F.col("s_norm"), "text": F.col("c_norm"), "path": F.col("path")}
        total = F.lit(0)
        for name, op, literal, points, *word in self.tests:
            value = fields[name]
            hit = {"is": value == literal, "has": value.contains(literal), "ends": value.endswith(literal)}[op]
            if word:
                hit = hit & has_any(tokens, word)
            total = total + F.when(hit, points).otherwise(0)
        return total


# The general literal rules.
LITERAL_RULES = (
    LiteralRule("json export intent", (("export",), ("json",)), (
        ("name", "is", "to_json", 20), ("symbol", "has", "to json", 16),
        ("path", "ends", "export.py", 10), ("symbol", "has", "json", 8),
    ), seeds=("to_json", "json", "export")),
    LiteralRule("report generation intent", (("report", "reports"), ("generate", "generated", "generat", "generation")), (
        ("name", "is", "generate", 18), ("path", "ends", "report.py", 12), ("symbol", "has", "report", 8),
    ), seeds=("generate", "report")),
    LiteralRule("community detection intent", (("community",), ("detection", "detect", "cluster")), (
        ("path", "ends", "cluster.py", 12), ("symbol", "has", "community", 12),
        ("symbol", "has", "cluster", 10), ("symbol", "has", "partition", 8),
    ), seeds=("cluster", "community", "partition")),
    LiteralRule("mcp server intent", (("mcp",), ("server",)), (
        ("name", "is", "serve", 18), ("path", "ends", "serve.py", 12), ("symbol", "has", "server", 8),
    ), seeds=("serve", "server")),
    LiteralRule("code extraction intent", (("extract", "extraction"),), (
        ("path", "ends", "extract.py", 12), ("symbol", "has", "extract", 14),
        ("symbol", "has", "python", 4, "code", "source"),
    ), seeds=("extract", "extract_python", "python")),
    LiteralRule("graph build intent", (("build", "built", "construct"), ("graph",)), (
        ("path", "ends", "build.py", 12), ("name", "is", "build", 16),
        ("symbol", "has", "build", 10), ("symbol", "has", "from json", 6, "graph"),
    ), seeds=("build",)),
    LiteralRule("query seed selection intent", (("seed", "seeds"), ("query", "select", "selected")), (
        ("name", "is", "_pick_seeds", 18), ("name", "is", "_score_nodes", 12),
        ("symbol", "has", "seed", 12), ("path", "ends", "serve.py", 8),
    ), seeds=("seed", "_pick_seeds", "_score_nodes")),
    LiteralRule("incremental indexing intent", (("incremental",), ("changed", "change", "indexing", "index")), (
        ("name", "is", "detect_incremental", 22), ("symbol", "has", "incremental", 12),
        ("symbol", "has", "manifest", 10), ("path", "ends", "detect.py", 8),
    )),
)


def load_rules(path: str) -> tuple[LiteralRule, ...]:
    """Literal rules from a JSON list of objects with the fields of ``LiteralRule``."""
    with open(path, encoding="utf-8") as handle:
        return tuple(
            LiteralRule(
                r["reason"], tuple(tuple(g) for g in r["all_of"]), tuple(tuple(t) for t in r["tests"]),
                tuple(r.get("none_of", ())), tuple(r.get("seeds", ())),
            )
            for r in json.load(handle)
        )


def dotted_references(question: Column) -> Column:
    """Distinct ``package.member`` mentions."""
    return F.array_distinct(
        F.regexp_extract_all(question, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)\b"), F.lit(1))
    )


def is_entrypoint(q_norm: Column, tokens: Column) -> Column:
    return (
        q_norm.contains("entry point") | has_any(tokens, ("entrypoint",))
        | (has_any(tokens, ("cli", "console")) & has_any(tokens, ("main",)))
    )


def seed_terms(queries: DataFrame, rules: Sequence[LiteralRule] = LITERAL_RULES) -> DataFrame:
    """(query_id, place, seed): names worth scanning for each request."""
    q = F.col("question")
    tokens = tx.ranked_tokens(q)
    none = F.array().cast("array<string>")
    parts = [
        F.when(is_entrypoint(tx.normalize_strict(q), tokens), strings(ENTRY_SEEDS)).otherwise(none),
        F.filter(
            F.transform(dotted_references(q), lambda r: F.lower(F.substring_index(r, ".", -1))),
            lambda m: F.length(m) >= 3,
        ),
    ]
    parts += [F.when(r.gate(tokens), strings(r.seeds)).otherwise(none) for r in rules if r.seeds]
    return queries.select(
        "query_id", F.posexplode(F.array_distinct(F.concat(*parts))).alias("place", "seed")
    )


def _owner_phrase() -> Column:
    return F.array_join("o_tokens", " ")


def _owner_signal() -> Column:
    return F.col("question").rlike(r"\b[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b")


def _plain_method() -> Column:
    return (
        (F.col("kind") == "method") & ~(F.col("is_property") & ~F.col("names_symbol"))
        & ~(F.col("is_dunder") & ~F.col("asks_dunder"))
    )


def _named_owner_api() -> Column:
    c = F.col
    own = F.filter("b_tokens", lambda t: ~F.array_contains(c("o_tokens"), t))
    covered = F.forall(
        own, lambda t: F.array_contains(c("q_tokens"), t) | ((t == "dump") & has_any(c("q_tokens"), DUMP_WORDS))
    )
    echo = F.size("b_tokens") > F.size(own)
    ok = (
        _plain_method() & (F.size("o_tokens") > 0) & c("q_norm").contains(_owner_phrase())
        & (F.size(own) > 0) & covered & (echo | has_any(own, PUBLIC_API_WORDS))
    )
    points = (
        44 + 5 * F.least(F.size(own), F.lit(3)) + F.when(echo, 4).otherwise(0)
        + F.when(c("f_norm").contains(F.element_at("o_tokens", -1)), 2).otherwise(0)
    )
    return F.when(_owner_signal() & ok, points).otherwise(0)


def _owner_method() -> Column:
    c = F.col
    does = (F.get("b_tokens", F.lit(0)) == "do") & (F.size("b_tokens") > 1)
    tokens = F.when(does, F.slice("b_tokens", 2, F.size("b_tokens"))).otherwise(c("b_tokens"))
    compiler = has_any(c("q_tokens"), ("compiler", "sqlcompiler")) & ~has_any(c("o_tokens"), ("compiler", "sqlcompiler"))
    owner_known = F.when(F.size("o_tokens") > 1, c("q_norm").contains(_owner_phrase())).otherwise(
        F.array_contains(c("q_tokens"), F.get("o_tokens", F.lit(0)))
    )
    ok = (
        (c("kind") == "method")
        & ~(c("question").rlike("__[A-Za-z0-9_]+__") & ~c("asks_dunder"))
        & ~(c("is_dunder") & ~c("asks_dunder"))
        & (F.size("o_tokens") > 0) & (F.size(tokens) > 0) & ~compiler
        & owner_known & tx.in_query_order(tokens, c("q_tokens"))
    )
    points = (
        22 + 4 * F.least(F.size(tokens), F.lit(3)) + F.when(F.size(tokens) >= 2, 4).otherwise(0)
        + F.when(F.size("o_tokens") > 1, 18).otherwise(0)
        + F.when(F.get("b_tokens", F.lit(0)) == "do", 8).otherwise(0)
    )
    return F.when(_owner_signal() & ok, points).otherwise(0)


def _reference_matches(r: Column) -> Column:
    package, member = F.substring_index(r, ".", 1), F.substring_index(r, ".", -1)
    owner = tx.normalize_strict(tx.owner(F.col("qualified_name"))) == tx.normalize_strict(package)
    return (F.col("name") == member) & (~package.rlike("^[A-Z]") | owner)


def _direct_owner_action() -> Column:
    c = F.col
    refs = dotted_references(c("question"))
    action = F.get(F.filter("q_tokens", lambda t: t.isin(*OWNER_ACTIONS)), F.lit(0))
    explicit = F.exists(refs, lambda r: r.rlike("^[A-Z]")) & ~F.exists(refs, _reference_matches)
    console = (
        (action == "parse") & F.forall(c("o_tokens"), lambda t: t.isin("config", "configuration"))
        & has_any(c("q_tokens"), ("console", "command", "session", "main"))
    )
    ok = (
        (c("kind") == "method") & action.isNotNull() & ~explicit & (F.size("o_tokens") > 0)
        & (F.size(F.array_except("o_tokens", "q_tokens")) == 0) & ~console
        & F.exists(c("b_tokens"), lambda t: action_match(t, action))
    )
    return F.when(ok, 34 + 3 * F.least(F.size("b_tokens"), F.lit(3))).otherwise(0)


def _create_object() -> Column:
    c = F.col
    objects = F.filter(F.slice("b_tokens", 2, F.greatest(F.size("b_tokens"), F.lit(1))), lambda t: ~t.isin(*CONNECTORS))
    at = F.array_position(F.transform("q_tokens", lambda t: t.isin(*FACTORY_QUESTION)), True)
    after = F.filter(
        F.slice("q_tokens", (at + 1).cast("int"), F.greatest(F.size("q_tokens"), F.lit(1))),
        lambda t: ~t.isin(*CONNECTORS),
    )
    target = F.when(at > 0, F.get(after, F.lit(0)))
    covered = F.forall(
        objects, lambda t: F.array_contains(c("q_tokens"), t) | F.array_contains(c("q_tokens"), tx.stem(t))
    )
    base = F.when(F.coalesce(tx.loosely_equal(F.get(objects, F.lit(0)), target), F.lit(False)), 40).when(covered, 18).otherwise(0)
    ok = (
        (c("kind") == "function") & has_any(c("q_tokens"), FACTORY_QUESTION)
        & F.get("b_tokens", F.lit(0)).isin(*FACTORY_ACTIONS) & (F.size(objects) > 0) & (base > 0)
    )
    return F.when(ok, base + F.when(tx.in_query_order(c("b_tokens"), c("q_tokens")), 8).otherwise(0)).otherwise(0)


def _default_decision() -> Column:
    c = F.col
    text = tx.normalize_strict(F.concat_ws(" ", "qualified_name", "path", "text"))
    overlap = F.size(F.filter(
        "q_tokens",
        lambda t: (F.length(t) >= 3) & ~t.isin(*DECISION_GENERIC) & ~tx.stem(t).isin(*DECISION_GENERIC)
        & (F.array_contains(c("b_tokens"), t) | F.array_contains(c("b_tokens"), tx.stem(t)) | text.contains(t)),
    ))
    ok = (
        has_any(c("q_tokens"), DEFAULT_WORDS) & has_any(c("q_tokens"), DECISION_WORDS)
        & (c("role") == "source") & c("kind").isin("function", "method") & has_any(c("b_tokens"), DEFAULT_WORDS)
        & F.exists(c("b_tokens"), lambda t: tx.stem(t).isin(*RESOLVER_WORDS)) & (overlap > 0)
    )
    return F.when(
        ok, 42 + F.least(8 * overlap, F.lit(24)) + F.when(c("kind") == "function", 8).otherwise(0)
    ).otherwise(0)


def _dotted_api() -> Column:
    c = F.col
    module_level = c("q_norm").contains("module level")
    api_question = module_level | has_any(c("q_tokens"), API_WORDS)

    def one(r: Column) -> Column:
        points = (
            F.when(r.rlike("^[A-Z]"), 34).otherwise(18)
            + F.when(c("path").startswith(F.concat(F.substring_index(r, ".", 1), F.lit("/"))), 8).otherwise(0)
            + F.when(module_level & (c("kind") == "function"), 8).otherwise(0)
            + F.when(has_any(c("q_tokens"), ("function",)) & (c("kind") == "function"), 6).otherwise(0)
            + F.when(has_any(c("q_tokens"), ("defined", "definition")), 4).otherwise(0)
            - F.when((c("kind") == "method") & module_level, 10).otherwise(0)
        )
        return F.when(((r != F.lower(r)) | api_question) & _reference_matches(r), points).otherwise(0)

    return F.coalesce(F.array_max(F.transform(dotted_references(c("question")), one)), F.lit(0))


def _domain_match(domain: Column, word: Column) -> Column:
    hit = tx.stem(domain) == tx.stem(word)
    for name, aliases in DOMAIN_ALIASES.items():
        hit = hit | ((tx.stem(domain) == name) & tx.stem(word).isin(*aliases))
    return hit


def _module_domain() -> Column:
    c = F.col
    wanted = F.filter("q_tokens", lambda t: F.exists(strings(DOMAIN_MODULES), lambda d: _domain_match(d, t)))
    stem = F.filter("stem_tokens", lambda t: F.length(t) >= 4)
    reader = F.exists(stem, lambda t: tx.stem(t) == "reader") & ~has_any(c("q_tokens"), READER_WORDS)
    ok = (
        c("kind").isin("function", "method", "class") & (F.size(wanted) > 0)
        & F.exists(stem, lambda f: F.exists(wanted, lambda q: _domain_match(f, q))) & ~reader
    )
    points = (
        20 + F.when(c("kind").isin("function", "method"), 6).otherwise(0)
        + 6 * F.size(F.filter("b_tokens", lambda t: _any_loose(c("q_tokens"), t)))
        + F.size(F.filter("q_tokens", lambda t: (F.length(t) >= 4) & c("c_norm").contains(t)))
    )
    return F.when(ok, points).otherwise(0)


def _serialization() -> Column:
    c = F.col
    q = c("q_tokens")
    compatible = (
        has_any(q, ("convert", "conversion", "encode", "encoder")) & has_any(q, ("json", "jsonable"))
        & has_any(q, ("compatible", "data", "value", "values"))
    )
    points = (
        F.when(has_any(q, ("dict", "dictionary", "dictionaries")) & c("n_norm").isin("asdict", "to dict"), 42).otherwise(0)
        + F.when(has_any(q, ("tuple", "tuples")) & c("n_norm").isin("astuple", "to tuple"), 42).otherwise(0)
        + F.when(has_any(q, ("json", "jsonable")) & c("n_norm").isin("to json", "json"), 34).otherwise(0)
        + F.when(compatible & c("n_norm").rlike("jsonable|encode"), 48).otherwise(0)
        + F.when(compatible & c("s_norm").contains("encoder"), 10).otherwise(0)
        + F.when(c("s_norm").contains("serializ"), 8).otherwise(0)
    )
    ok = (
        c("kind").isin("function", "method") & has_any(q, SERIALIZE_ACTIONS)
        & has_any(q, SERIALIZE_OBJECTS) & has_any(q, SERIALIZE_OUTPUTS)
    )
    return F.when(ok, points).otherwise(0)


def _lifecycle() -> Column:
    c = F.col
    actions = F.array_intersect(strings(LIFECYCLE_ACTIONS), c("q_tokens"))
    matched = F.size(F.filter(actions, lambda a: F.exists(c("b_tokens"), lambda s: action_match(s, a))))
    domain = F.size(F.filter(
        "q_tokens",
        lambda t: (F.length(t) >= 4) & ~F.array_contains(actions, t) & _any_loose(c("b_tokens"), t),
    ))
    ok = c("kind").isin("function", "method") & (F.size(actions) >= 2) & (matched > 0) & (domain > 0)
    return F.when(ok, 10 * matched + 4 * F.least(domain, F.lit(2))).otherwise(0)


def _entrypoint() -> Column:
    c = F.col
    main = c("name") == "main"
    console = has_any(c("q_tokens"), ("console",)) & has_any(c("q_tokens"), ("main",))
    points = (
        F.when(c("path").endswith("__main__.py"), 20).otherwise(0)
        + F.when(console & (c("n_norm") == "console main"), 48).otherwise(0)
        + F.when(console & (c("n_norm") == "main"), 12).otherwise(0)
        + F.when(main, 24).otherwise(0) + F.when(c("name") == "_main", 10).otherwise(0)
        + F.when(main & c("f_norm").contains("application"), 8).otherwise(0)
        + F.when(main & c("c_norm").contains("application"), 4).otherwise(0)
        + F.when(main & c("c_norm").contains("run"), 4).otherwise(0)
        + F.when(c("s_norm").contains(" cli "), 6).otherwise(0)
    )
    return F.when(is_entrypoint(c("q_norm"), c("q_tokens")), points).otherwise(0)


GENERAL_RULES = (
    ("named owner API intent", _named_owner_api),
    ("owner method intent", _owner_method),
    ("direct owner action intent", _direct_owner_action),
    ("create object factory intent", _create_object),
    ("default decision resolver intent", _default_decision),
    ("dotted API reference match", _dotted_api),
    ("module domain intent", _module_domain),
    ("object serialization intent", _serialization),
    ("lifecycle action match", _lifecycle),
    ("entrypoint intent match", _entrypoint),
)


def boosts(rows: DataFrame, rules: Sequence[LiteralRule] = LITERAL_RULES) -> DataFrame:
    """Add ``boost`` and ``reasons`` to prepared rows: the best rule counts, all are named."""
    scores = [(reason, make()) for reason, make in GENERAL_RULES]
    scores += [
        (r.reason, F.when(r.gate(F.col("q_tokens")), r.score(F.col("q_tokens"))).otherwise(0)) for r in rules
    ]
    held = rows.withColumn("_rules", F.array(*[
        F.struct(F.lit(reason).alias("reason"), score.cast("double").alias("score")) for reason, score in scores
    ]))
    fired = F.filter("_rules", lambda r: r["score"] > 0)
    return held.withColumn("_rules", fired).withColumns({
        "boost": F.coalesce(F.array_max(F.col("_rules.score")) + RULE_BOOST, F.lit(0.0)),
        "reasons": F.array_distinct(F.col("_rules.reason")),
    }).drop("_rules")
