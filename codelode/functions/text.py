"""Text kernels as Column expressions.

Three normalisers coexist on purpose: strict for search and indexing, loose
for clusters, related tests and evidence, dotted for module identity. All of
them stay inside whole-stage codegen; none needs Python workers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CAMEL = r"([a-z0-9])([A-Z])"


def camel_split(c: Column) -> Column:
    return F.regexp_replace(c, _CAMEL, "$1 $2")


def normalize_strict(c: Column) -> Column:
    """Camel split, lower case, every run of other characters one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(camel_split(c)), "[^a-z0-9]+", " "))


def normalize_loose(c: Column) -> Column:
    """Camel split, path punctuation to a space, lower case; the rest is kept."""
    return F.lower(F.regexp_replace(camel_split(c), r"[_\-./]+", " "))


def normalize_dotted(c: Column) -> Column:
    """Module identity: slashes to dots, other punctuation to a space, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c, "\\/", ".."), r"[^A-Za-z0-9_.]+", " ")))


def normalize_target(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as an ASCII-folding SQL ``lower`` does."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stem(t: Column) -> Column:
    """Query stem: the first suffix that applies is cut, with length guards."""
    n = F.length(t)
    return (
        F.when(t.endswith("ing") & (n > 5), t.substr(F.lit(1), n - 3))
        .when(t.endswith("ed") & (n > 4), t.substr(F.lit(1), n - 2))
        .when(t.endswith("s") & (n > 3), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def cluster_stem(t: Column) -> Column:
    """Cluster stem: one suffix is cut whatever is left."""
    return F.regexp_replace(t, "(ing|ed|es|s)$", "")


def strip(c: Column) -> Column:
    """Without white space at both ends; takes one argument, so it can be mapped over arrays."""
    return F.trim(c, F.lit(" \t\r\n\f\v\u00a0"))


def words(normalized: Column, min_length: int = 1) -> Column:
    """Whitespace tokens of an already normalised string."""
    return F.filter(F.split(normalized, r"\s+"), lambda t: F.length(t) >= min_length)


def query_tokens(c: Column) -> Column:
    return words(normalize_strict(c), 2)


def ranked_tokens(c: Column) -> Column:
    """Each token followed by its stem, first occurrences only, two characters or more."""
    pairs = F.flatten(F.transform(query_tokens(c), lambda t: F.array(t, stem(t))))
    return F.array_distinct(F.filter(pairs, lambda t: F.length(t) >= 2))


# The pairs that count as the same word besides equal stems.
LOOSE_SYNONYMS = (("pipe", "pipeline"), ("keep", "stay"), ("sync", "synchronous"))
ORDER_SYNONYMS = (("keep", "stay"), ("sync", "synchronous"))
PARAMETER_WORDS = ("param", "params", "parameter", "parameters")


def _either_way(a: Column, b: Column, pairs) -> Column:
    hit = F.lit(False)
    for left, right in pairs:
        hit = hit | ((a == left) & (b == right)) | ((a == right) & (b == left))
    return hit


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal, equal stems, synonyms, or a common prefix of five characters."""
    prefix = (F.length(a) >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 5) == F.substring(b, 1, 5))
    return (a == b) | (stem(a) == stem(b)) | _either_way(a, b, LOOSE_SYNONYMS) | prefix


def order_equal(a: Column, b: Column) -> Column:
    """The stricter match used when a name must appear in query order."""
    params = a.isin(*PARAMETER_WORDS) & b.isin(*PARAMETER_WORDS)
    return (a == b) | (stem(a) == stem(b)) | _either_way(a, b, ORDER_SYNONYMS) | params


def in_query_order(symbol_tokens: Column, tokens: Column) -> Column:
    """All symbol tokens are found left to right among the query tokens."""
    done = F.aggregate(
        tokens,
        F.lit(0),
        lambda i, q: F.when(
            (i < F.size(symbol_tokens)) & order_equal(F.get(symbol_tokens, i), q), i + 1
        ).otherwise(i),
    )
    return done == F.size(symbol_tokens)


def _fold_tables() -> tuple[str, str]:
    """Accent folding for ``translate``, derived from Unicode decomposition."""
    source, target = [], []
    for code in list(range(0x00C0, 0x0250)) + list(range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            source.append(chr(code))
            target.append(parts[0])
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_tables()


def fold(c: Column) -> Column:
    """Lower case without accents; combining marks are dropped."""
    return F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)


def fts_tokens(c: Column) -> Column:
    """Full-text tokens: runs of letters and digits, case and accents folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def searchable_text(text: Column, symbol_name: Column) -> Column:
    """The indexed body: raw text, its strict form, and the strict symbol name."""
    return F.concat_ws("\n", text, normalize_strict(text), normalize_strict(symbol_name))


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


def like_pattern(literal: Column) -> Column:
    """``%literal%`` where wildcards inside the literal stay wildcards."""
    return F.concat(F.lit("%"), literal, F.lit("%"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def leaf(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def owner(qualified: Column) -> Column:
    """Everything before the last dot, empty without one."""
    return F.when(qualified.contains("."), F.regexp_replace(qualified, r"\.[^.]*$", "")).otherwise(F.lit(""))


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value computed once, however often ``make`` reads it within functions over arrays."""
    return F.transform(F.array(value), make)[0]


def evidence_line(text: Column, terms: Column, width: int = 96) -> Column:
    """The trimmed line holding most terms.

    A line wins by a higher count, or by the same count when the line held so
    far is a definition line and the new one is not.
    """
    def signature(s: Column) -> Column:
        return s.rlike(r"^(async\s+def|def|class)\s")

    def held_most(given: Column) -> Column:
        lines, wanted = given["lines"], given["wanted"]
        scored = F.transform(F.transform(lines, lambda s: F.struct(s.alias("line"), normalize_loose(s).alias("loose"))), lambda x: F.struct(
            x["line"].alias("line"), F.size(F.filter(wanted, lambda t: x["loose"].contains(t))).alias("hits"),
            signature(x["line"]).alias("sig")))
        first = F.get(lines, F.lit(0))
        start = F.struct(
            F.coalesce(first, F.lit("")).alias("line"), F.lit(0).alias("hits"), F.coalesce(signature(first), F.lit(False)).alias("sig"))
        return F.aggregate(
            scored,
            start,
            lambda kept, s: F.when(
                (s["hits"] > kept["hits"]) | ((s["hits"] == kept["hits"]) & kept["sig"] & ~s["sig"]), s
            ).otherwise(kept),
        )["line"]

    lines = F.filter(F.transform(F.split(text, r"\r?\n"), strip), lambda s: s != "")
    wanted = F.filter(F.transform(terms, normalize_loose), lambda t: F.length(t) >= 2)
    best = once(F.struct(lines.alias("lines"), wanted.alias("wanted")), held_most)
    flat = F.regexp_replace(best, r"\s+", " ")
    return F.when(
        F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width - 3)), F.lit("..."))
    ).otherwise(flat)
