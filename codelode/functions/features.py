"""Row features of a match: how well one candidate answers one request.

``prepare`` derives the normalised texts and token arrays once per row;
``evaluate`` turns them into a score and the list of reasons. Everything is a
Catalyst expression over the joined candidate row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import text as tx

# Vocabularies and weights the ranking depends on.
SUPPORT_WORDS = ("rationale", "note", "notes", "doc", "docs", "describe", "description", "explain")
HTTP_VERBS = ("get", "post", "put", "delete", "options", "head", "patch", "trace")
CONSTRUCTOR_WORDS = ("init", "initialize", "initialized", "constructor")
ACTION_WORDS = ("perform",)
FILE_ACTION_WORDS = ("collect",)
CONNECTORS = ("a", "an", "the", "from", "for", "with", "by", "to", "of", "and", "or")
COVERAGE_SKIPPED = (*CONNECTORS, "if", "else", "then", "when", "unless")
FLOW_WORDS = ("flow", "stateflow", "sharedflow", "suspend", "coroutine", "collect", "emit", "map", "transform", "launch")
FLOW_EVIDENCE = ("flow", "stateflow", "sharedflow", "suspend", "collect", "emit", "map", "transform", "launch", "viewmodelscope")
GRADLE_WORDS = (
    "gradle", "plugin", "dependency", "dependencies", "target", "module", "implementation", "api",
    "project", "sourceset", "sourcesets", "wires", "wiring",
)
GRADLE_SYMBOLS = ("implementation", "api", "testimplementation", "androidtestimplementation", "plugin", "include", "namespace")
DI_WORDS = ("di", "inject", "injected", "hilt", "koin", "module", "single", "factory")
DI_EVIDENCE = ("inject", "hiltviewmodel", "module", "single", "factory", "provides", "binds", "koin")
BUILD_WORDS = (
    "gradle", "maven", "pom", "plugin", "dependency", "dependencies", "target", "module",
    "implementation", "api", "project", "artifact", "artifactid", "groupid", "catalog", "alias",
    "library", "libraries", "version", "versions", "coordinate", "coordinates", "wires", "wiring",
)
BUILD_SYMBOLS = ("dependency", "implementation", "api", "plugin", "module", "project", "catalog", "library", "version", "sourceset")
BUILD_EVIDENCE = ("dependency", "artifactid", "groupid", "plugin", "module", "project", "version", "version ref")
CYTHON_WORDS = (
    "backend", "brute", "cdef", "cimport", "cpdef", "cython", "dense", "distance", "distances",
    "float32", "float64", "fused", "nogil", "parallel", "prange", "reduction", "sparse", "template",
)
CYTHON_EVIDENCE = (
    "cdef", "cpdef", "cimport", "nogil", "prange", "floating", "float32", "float64", "intp",
    "parallel", "reduction", "distances",
)
REPRESENTATION_WORDS = ("represented", "representation", "config", "configuration")
OPTION_WORDS = ("option", "options", "register", "registered", "define", "defined", "declare", "declared")
HOOK_WORDS = ("hook", "hookspec", "spec", "specification")
CYTHON_FILE = r"\.(?:pyx|pxd|pxi)(?:\.(?:tp|in))?$"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_any(tokens: Column, vocabulary) -> Column:
    return F.arrays_overlap(tokens, strings(vocabulary))


def contained(vocabulary, *texts: Column) -> Column:
    """How many words of the vocabulary occur in at least one of the texts."""

    def hit(t: Column) -> Column:
        found = texts[0].contains(t)
        for other in texts[1:]:
            found = found | other.contains(t)
        return found

    return F.size(F.filter(strings(vocabulary), hit))


def bare_tokens(name: Column) -> Column:
    return tx.words(tx.normalize_strict(F.regexp_replace(name, "^_+", "")))


def prepare(rows: DataFrame) -> DataFrame:
    """Derived columns of candidate rows that carry a ``question``."""
    c = F.col
    return rows.withColumns({
        "q_norm": tx.normalize_strict(c("question")),
        "q_tokens": tx.ranked_tokens(c("question")),
        "s_norm": tx.normalize_strict(c("qualified_name")),
        "n_norm": tx.normalize_strict(c("name")),
        "f_norm": tx.normalize_strict(c("path")),
        "c_norm": tx.normalize_strict(c("text")),
        "b_tokens": bare_tokens(c("name")),
        "o_tokens": tx.words(tx.normalize_strict(tx.owner(c("qualified_name")))),
        "stem_tokens": tx.words(tx.normalize_strict(F.regexp_replace(tx.basename(c("path")), r"\.py$", ""))),
    }).withColumns({
        "s_tokens": tx.words(c("s_norm")),
        "n_tokens": tx.words(c("n_norm")),
        "is_dunder": (c("kind") == "method") & c("name").startswith("__") & c("name").endswith("__"),
        "is_property": (c("kind") == "method") & c("text").rlike(r"(^|\n)\s*@property\b"),
        "names_symbol": c("q_norm").contains(c("s_norm")),
    }).withColumn(
        "asks_dunder",
        c("names_symbol") | c("question").contains(c("name"))
        | ((c("name") == "__init__") & has_any(c("q_tokens"), CONSTRUCTOR_WORDS)),
    )


def _any_loose(tokens: Column, other: Column) -> Column:
    return F.exists(tokens, lambda t: tx.loosely_equal(t, other))


def action_match(token: Column, action: Column) -> Column:
    """A symbol token states an action: equal, loosely equal, or the action plus more."""
    longer = (F.length(action) >= 3) & token.startswith(action) & (F.length(token) > F.length(action))
    return (token == action) | (tx.stem(token) == action) | tx.loosely_equal(token, action) | longer


def _word_counts():
    q = F.col("q_tokens")
    in_symbol = lambda t: F.col("s_norm").contains(t) | _any_loose(F.col("n_tokens"), t)
    in_name = lambda t: F.col("n_norm").contains(t) | _any_loose(F.col("n_tokens"), t)
    total = (
        F.size(F.filter(q, lambda t: F.col("c_norm").contains(t)))
        + 2 * F.size(F.filter(q, in_symbol))
        + F.size(F.filter(q, lambda t: F.col("f_norm").contains(t)))
    )

    def first(test):
        return F.array_position(F.transform(q, test), True)

    places = F.array(
        F.struct(first(in_symbol).alias("at"), F.lit(0).alias("slot"), F.lit("symbol name match").alias("reason")),
        F.struct(
            F.when(F.col("kind") == "method", first(in_name)).otherwise(F.lit(0).cast("long")).alias("at"),
            F.lit(1).alias("slot"), F.lit("method name match").alias("reason"),
        ),
        F.struct(
            first(lambda t: F.col("f_norm").contains(t)).alias("at"),
            F.lit(2).alias("slot"), F.lit("file path match").alias("reason"),
        ),
    )
    reasons = F.array_sort(F.filter(places, lambda p: p["at"] > 0))["reason"]
    return total.cast("double"), reasons


def _exact_symbol_name():
    c = F.col
    tokens = c("b_tokens")
    trimmed = F.when(
        (F.size(tokens) >= 3) & F.get(tokens, F.lit(0)).isin("handle", "on"),
        F.slice(tokens, 2, F.size(tokens)),
    ).otherwise(tokens)
    return (
        F.when(~c("kind").isin("function", "method"), 0)
        .when(c("is_dunder") & c("asks_dunder"), 18)
        .when(F.size(trimmed) < 2, 0)
        .when(c("q_norm").contains(F.array_join(trimmed, " ")), 10)
        .when(tx.in_query_order(trimmed, c("q_tokens")), 8)
        .otherwise(0)
    )


def _core_symbol():
    c = F.col
    same = (
        (F.size("stem_tokens") > 0) & (c("kind") == "function") & (F.size("b_tokens") == F.size("stem_tokens"))
        & F.forall(c("stem_tokens"), lambda f: _any_loose(c("b_tokens"), f))
    )
    support = F.size(F.array_intersect(c("b_tokens"), strings(SUPPORT_WORDS)))
    return F.when(same, 6).otherwise(0) - 8 * support


def decorator_targets(question_norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question_norm, F.lit(r"\b([a-z0-9]+)\s+decorators?\b"), F.lit(1)))


def _single_name_among(targets: Column) -> Column:
    return (F.size("b_tokens") == 1) & F.exists(targets, lambda t: _any_loose(F.col("b_tokens"), t))


def _owner_name():
    c = F.col
    ok = (
        (c("kind") == "method") & ~(c("is_property") & ~c("names_symbol"))
        & F.arrays_overlap("o_tokens", "q_tokens") & F.arrays_overlap("n_tokens", "q_tokens")
    )
    return F.when(ok, 3).otherwise(0)


def _owner_source():
    c = F.col
    targets = decorator_targets(c("q_norm"))
    behaviour = F.size(F.filter(
        "q_tokens",
        lambda t: ~F.array_contains(c("o_tokens"), t) & (F.length(t) >= 4) & c("c_norm").contains(t),
    ))
    ok = (
        (c("kind") == "method") & ~(c("is_property") & ~c("names_symbol"))
        & ~(c("is_dunder") & ~c("asks_dunder"))
        & ~(c("name").isin(*HTTP_VERBS) & ~F.arrays_overlap("n_tokens", "q_tokens"))
        & ((F.size(targets) == 0) | _single_name_among(targets))
        & (F.size(F.array_except("o_tokens", "q_tokens")) == 0)
        & (behaviour >= 2)
    )
    return F.when(ok, 3).otherwise(0)


def _token_coverage():
    tokens = F.filter("b_tokens", lambda t: ~t.isin(*COVERAGE_SKIPPED))
    ok = (F.size(tokens) >= 2) & F.forall(tokens, lambda t: _any_loose(F.col("q_tokens"), t))
    return F.when(ok, 4).otherwise(0)


def _action_domain():
    c = F.col
    actions = F.array_intersect(strings(ACTION_WORDS), c("q_tokens"))
    acted = F.exists(actions, lambda a: F.exists(c("b_tokens"), lambda s: action_match(s, a)))
    domain = F.filter("q_tokens", lambda t: ~F.array_contains(actions, t) & (F.length(t) >= 5))
    ok = c("kind").isin("function", "method") & acted & F.exists(domain, lambda t: _any_loose(c("b_tokens"), t))
    return F.when(ok, 14).otherwise(0)


def _file_context():
    c = F.col
    stem = F.filter("stem_tokens", lambda t: F.length(t) >= 4)
    actions = F.array_intersect(strings(FILE_ACTION_WORDS), c("q_tokens"))
    ok = (
        c("kind").isin("function", "method", "class") & (F.size(stem) > 0)
        & F.forall(stem, lambda f: _any_loose(c("q_tokens"), f))
        & F.exists(actions, lambda a: F.exists(c("b_tokens"), lambda s: action_match(s, a)))
    )
    return F.when(ok, 16).otherwise(0)


def path_hint_score() -> Column:
    """28 for a named file, 14 for a path part, 2 for loose words; 30 at most."""
    file_norm = F.col("f_norm")

    def one(raw: Column) -> Column:
        hint = tx.normalize_strict(F.regexp_replace(raw, r"\.py$", ""))
        slash = raw.rlike(r"[\\/]")
        tokens = F.filter(tx.words(hint, 2), lambda t: t != "py")
        loose = (F.size(tokens) > 0) & F.forall(tokens, lambda t: _any_loose(tx.words(file_norm), t))
        return (
            F.when(hint == "", 0)
            .when(slash & raw.rlike(r"\.[A-Za-z0-9]+$")
                  & ((file_norm == hint) | file_norm.endswith(F.concat(F.lit(" "), hint))), 28)
            .when(file_norm.contains(hint), F.when(slash, 14).otherwise(2))
            .when(loose, 2)
            .otherwise(0)
        )

    hints = F.coalesce(F.col("path_hints"), F.array().cast("array<string>"))
    return F.least(F.aggregate(F.transform(hints, one), F.lit(0), lambda a, b: a + b), F.lit(30))


def _swift_body():
    c = F.col
    q = c("q_tokens")
    flow = has_any(q, ("swiftui",)) | (has_any(q, ("view",)) & has_any(q, ("body", "model", "action", "button")))
    ok = c("path").endswith(".swift") & (c("kind") == "method") & (c("name") == "body") & flow & has_any(q, ("body",))
    return F.when(ok, 14).otherwise(0)


def _kotlin():
    c = F.col
    q = c("q_tokens")
    flow = contained(FLOW_EVIDENCE, c("c_norm"), c("s_norm"))
    di = contained(DI_EVIDENCE, c("c_norm"), c("s_norm"))
    script = c("path").endswith(".gradle.kts")
    total = (
        F.when(has_any(q, FLOW_WORDS) & (flow > 0) & c("kind").isin("function", "method"), F.least(10 + 3 * flow, F.lit(24))).otherwise(0)
        + F.when(
            has_any(q, GRADLE_WORDS) & script,
            12 + F.when(c("s_norm").startswith("gradle "), 10).otherwise(0)
            + F.when(contained(GRADLE_SYMBOLS, c("s_norm")) > 0, 8).otherwise(0),
        ).otherwise(0)
        + F.when(has_any(q, DI_WORDS) & (di > 0), F.least(8 + 4 * di, F.lit(24))).otherwise(0)
        + F.when(
            has_any(q, ("extension", "receiver")) & (c("kind") == "function") & (F.size("s_tokens") >= 2),
            12 + F.when(c("c_norm").contains("fun ") & c("qualified_name").contains("."), 8).otherwise(0),
        ).otherwise(0)
        + F.when(has_any(q, ("viewmodel", "ui", "state")) & c("f_norm").contains("viewmodel"), 8).otherwise(0)
    )
    return F.when(c("path").rlike(r"\.kts?$"), F.least(total, F.lit(36))).otherwise(0)


def _build_tool():
    c = F.col
    is_build = c("path").endswith(".gradle.kts") | c("path").endswith("pom.xml") | c("path").endswith("libs.versions.toml")
    total = (
        10 + F.when(c("s_norm").rlike("^(gradle|maven) "), 10).otherwise(0)
        + F.when(contained(BUILD_SYMBOLS, c("s_norm")) > 0, 8).otherwise(0)
        + F.when(contained(BUILD_EVIDENCE, c("c_norm")) > 0, 6).otherwise(0)
    )
    return F.when(is_build & has_any(c("q_tokens"), BUILD_WORDS), F.least(total, F.lit(30))).otherwise(0)


def _cython():
    c = F.col
    n = contained(CYTHON_EVIDENCE, c("c_norm"), c("s_norm"), c("f_norm"))
    kind = F.when(c("kind").isin("method", "function"), 8).when(c("kind") == "class", 5).otherwise(2)
    ok = c("path").rlike(CYTHON_FILE) & has_any(c("q_tokens"), CYTHON_WORDS) & (n > 0)
    return F.when(ok, F.least(kind + 3 * n, F.lit(28))).otherwise(0)


def _test_api():
    c = F.col
    raw = F.filter(
        F.transform(
            F.split(F.trim("question"), r"\s+"),
            lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""),
        ),
        lambda t: t.rlike(r"[._]"),
    )
    terms = F.array_distinct(raw)
    phrases = F.array_distinct(F.filter(F.transform(raw, tx.normalize_strict), lambda p: p.contains(" ")))

    def call(t: Column) -> Column:
        name = F.concat(F.lit(r"\Q"), F.substring_index(t, ".", -1), F.lit(r"\E"))
        return (
            F.when(F.rlike(c("text"), F.concat(F.lit(r"(?:\.|\b)"), name, F.lit(r"\s*\("))), 14)
            .when(F.rlike(c("text"), F.concat(F.lit(r"\b"), name, F.lit(r"\s*="))), 4)
            .otherwise(0)
        )

    named = F.size(F.filter("q_tokens", lambda t: (F.length(t) >= 5) & F.array_contains(c("n_tokens"), t)))
    total = (
        8 * F.size(F.filter(phrases, lambda p: c("c_norm").contains(p)))
        + 10 * F.size(F.filter(phrases, lambda p: c("n_norm").contains(p)))
        + F.least(2 * named, F.lit(8))
        + F.aggregate(F.transform(terms, call), F.lit(0), lambda a, b: a + b)
    )
    return F.when(c("role") == "test", F.least(total, F.lit(36))).otherwise(0)


def _representation():
    c = F.col
    ok = (
        (c("kind") == "class") & has_any(c("q_tokens"), REPRESENTATION_WORDS) & (F.size("n_tokens") > 0)
        & (F.size(F.array_except("n_tokens", "q_tokens")) == 0)
    )
    return F.when(ok, 8 + F.when(c("f_norm").contains("config"), 4).otherwise(0)).otherwise(0)


def _class_container():
    c = F.col
    behaviour = F.filter("q_tokens", lambda t: (F.length(t) >= 5) & ~F.array_contains(c("s_tokens"), t))
    ok = (
        (c("kind") == "class") & c("names_symbol")
        & ~has_any(c("q_tokens"), ("class", *REPRESENTATION_WORDS)) & (F.size(behaviour) >= 4)
    )
    return F.when(ok, -14).otherwise(0)


def _option_registration():
    c = F.col
    ok = (
        c("n_norm").rlike("addoption|add option|add argument")
        & c("question").rlike("--[A-Za-z0-9][A-Za-z0-9-]*") & ~has_any(c("q_tokens"), OPTION_WORDS)
    )
    return F.when(ok, -10).otherwise(0)


def _short_flag():
    c = F.col
    flags = F.filter(
        F.regexp_extract_all("question", F.lit(r"--([A-Za-z][A-Za-z0-9-]*)\b"), F.lit(1)),
        lambda f: F.length(f) <= 3,
    )
    plain = F.regexp_replace("qualified_name", "[^A-Za-z0-9]", "")
    return F.when(F.exists(flags, lambda f: plain.contains(F.upper(f))), 12).otherwise(0)


def evaluate(rows: DataFrame) -> DataFrame:
    """Add ``score`` and ``why`` to prepared candidate rows.

    Rows carry boost, reasons (from candidate generation) and has_neighbours.
    """
    c = F.col
    word_score, word_reasons = _word_counts()
    quiet = F.array().cast("array<string>")

    def reason(score: Column, text: str, any_sign: bool = False) -> Column:
        return F.when((score != 0) if any_sign else (score > 0), F.array(F.lit(text))).otherwise(quiet)

    identifier = F.when(
        (F.size("s_tokens") > 1) & c("names_symbol"),
        F.when(c("kind").isin("method", "function"), 6).otherwise(3),
    ).otherwise(0)
    class_name = F.when(
        (c("kind") == "class")
        & (c("q_norm").contains(F.concat(c("n_norm"), F.lit(" class")))
           | c("q_norm").contains(F.concat(F.lit("class "), c("n_norm")))), 6,
    ).otherwise(0)
    targets = decorator_targets(c("q_norm"))
    decorator = F.when(
        c("kind").isin("function", "method") & (F.size(targets) > 0) & _single_name_among(targets), 8
    ).otherwise(0)
    hook = F.when(
        tx.basename(c("path")).contains("hookspec") & ~has_any(c("q_tokens"), HOOK_WORDS), -16
    ).otherwise(0)
    before = [
        ("exact_identifier", identifier, "exact identifier match", False),
        ("exact_symbol", _exact_symbol_name(), "exact symbol name match", False),
        ("exact_class", class_name, "exact class name match", False),
    ]
    after = [
        ("core_symbol", _core_symbol(), "core symbol match", False),
        ("owner_name", _owner_name(), "method owner/name match", False),
        ("owner_source", _owner_source(), "method owner/source match", False),
        ("coverage", _token_coverage(), "symbol token coverage match", False),
        ("action_domain", _action_domain(), "action/domain symbol match", False),
        ("file_context", _file_context(), "exact file context match", False),
        ("path_hint", path_hint_score(), "path hint match", False),
        ("swift_body", _swift_body(), "SwiftUI view body flow match", False),
        ("kotlin", _kotlin(), "Kotlin navigation signal match", False),
        ("build_tool", _build_tool(), "build tool ownership match", False),
        ("cython", _cython(), "Cython navigation signal match", False),
        ("test_api", _test_api(), "test API evidence match", False),
        ("decorator", decorator, "decorator target match", False),
        ("representation", _representation(), "representation class match", False),
        ("container", _class_container(), "named class container context", True),
        ("hook", hook, "hook specification context", True),
        ("option", _option_registration(), "option registration context", True),
        ("flag", _short_flag(), "short flag symbol match", False),
    ]
    scored = rows.withColumns({
        "f_words": word_score, "f_word_reasons": word_reasons,
        **{f"f_{name}": score.cast("double") for name, score, _, _ in before + after},
    })
    total = F.lit(1.0) + c("f_words") + c("boost") + F.when(c("has_neighbours"), 0.5).otherwise(0.0)
    for name, _, _, _ in before + after:
        total = total + c(f"f_{name}")
    why = F.array_distinct(F.concat(
        F.array(F.lit("matched source text")), c("f_word_reasons"),
        *[reason(c(f"f_{n}"), r, s) for n, _, r, s in before],
        F.when(c("boost") > 0, c("reasons")).otherwise(quiet),
        *[reason(c(f"f_{n}"), r, s) for n, _, r, s in after],
        F.when(c("has_neighbours"), F.array(F.lit("nearby graph edge"))).otherwise(quiet),
    ))
    return scored.withColumn("score", F.round(total, 3)).withColumn("why", why)
