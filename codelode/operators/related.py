"""Tests related to a source file: candidate pairs, signals, scores.

A test can only score if its path, imports, calls or body hold something the
request names. Those containments are equi-joins on short pieces of text, so
no request is paired with tests it has nothing in common with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codelode.functions import text as tx
from codelode.operators import fulltext as ft
from codelode.session import cut_lineage

# Words without meaning for layout, and further vocabularies.
LAYOUT_STOPWORDS = (
    "lib", "pkg", "src", "test", "tests", "testing", "unit", "utils", "util", "common", "core", "base", "main",
)
GENERIC_PATH_WORDS = ("algorithm", "algorithms")
NOUN_VERBS = ("build", "create", "get", "load", "make", "new", "open", "parse", "read", "resolve")
DEFAULT_LIMIT = 5
EMPTY = "array<string>"


def _words(c: Column, minimum: int) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: (F.length(t) >= minimum) & ~t.isin(*LAYOUT_STOPWORDS))


def module_names(path: Column) -> Column:
    """Names under which a test may import this file, per language."""
    base = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(path, r"\.(?:pyx|pxd|pxi)(?:\.(?:tp|in))?$", ""), r"\.[^./]+$", ""),
        "/__init__$", "",
    )
    stem, ext = tx.basename(base), F.substring_index(path, ".", -1)
    below = lambda pattern: F.regexp_extract(base, rf"^(?:[^/]+/)*?{pattern}/(.+)$", 1)
    rust, swift = below("src"), below("(?:Sources|Source)")
    jvm, java, cs = below("src/[^/]+/(?:kotlin|java)"), below("src/[^/]+/java"), below("(?:src|source|Sources)")
    twin = F.when(ext == "c", ".h").otherwise(".c")
    none = F.array().cast(EMPTY)
    names = F.concat(
        F.array(base),
        F.when(ext == "go", F.array(tx.dirname(base))).otherwise(none),
        F.when(ext.isin("c", "h"), F.array(stem, F.concat(base, twin), F.concat(stem, twin))).otherwise(none),
        F.when(ext == "rs", F.array(rust, F.regexp_replace(rust, "(?:^|/)(?:mod|lib|main)$", ""))).otherwise(none),
        F.when(ext == "swift", F.array(swift, F.substring_index(swift, "/", 1))).otherwise(none),
        F.when(ext.isin("kt", "kts"), F.array(jvm, tx.dirname(jvm))).otherwise(none),
        F.when(ext == "java", F.array(java, tx.dirname(java))).otherwise(none),
        F.when(ext == "cs", F.array(cs, tx.dirname(cs))).otherwise(none),
        F.array(
            F.when(base.endswith("/index"), F.regexp_replace(base, "/index$", "")),
            F.when(base.rlike("^(?:src|lib)/"), F.regexp_replace(base, "^(?:src|lib)/", "")),
        ),
    )
    return F.array_distinct(F.filter(F.transform(F.array_compact(names), tx.normalize_dotted), lambda n: n != ""))


def _path_variants(module: Column) -> Column:
    plain = F.regexp_replace(module, r"\.(?:cjs|mjs|jsx?|tsx?|dart|[ch])$", "")
    index = F.regexp_replace(plain, "/index$", "")
    rootless = lambda c: F.regexp_replace(c, "^(?:src|lib)/", "")
    return F.transform(F.array(plain, index, rootless(plain), rootless(index)), tx.normalize_dotted)


def resolve_relative(folder: Column, target: Column) -> Column:
    """Join and resolve ``.`` and ``..`` segments."""
    segments = F.split(F.concat_ws("/", folder, target), "/")
    kept = F.aggregate(
        segments, F.array().cast(EMPTY),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(kept, "/")


def import_variants(importer: Column, module: Column) -> Column:
    """Dotted names an import may stand for: relative, package, alias and index forms."""
    package = F.regexp_extract(module, "^package:[^/]+/(.+)$", 1)
    alias = F.regexp_replace(module, "^(?:@|~/|#/)", "")
    none = F.array().cast(EMPTY)
    relative = module.rlike(r"^\.{1,2}/")
    names = F.concat(
        F.array(tx.normalize_dotted(module)),
        F.when(relative, _path_variants(resolve_relative(tx.dirname(importer), module))).otherwise(_path_variants(module)),
        F.when(package != "", F.concat(_path_variants(package), _path_variants(F.concat(F.lit("lib/"), package)))).otherwise(none),
        F.when(
            module.rlike("^(?:@[^/]*|~|#)/.+"),
            F.concat(_path_variants(F.regexp_replace(alias, "^/", "")), _path_variants(F.concat(F.lit("src/"), F.regexp_replace(alias, "^/", "")))),
        ).otherwise(none),
    )
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def rust_uses(text: Column) -> Column:
    """Dotted names of ``use`` paths, without their root and last part too."""
    used = F.regexp_extract_all(text, F.lit(r"(?m)^\s*use\s+([^;]+);"), F.lit(1))
    parts = F.flatten(F.transform(
        used, lambda u: F.split(F.trim(F.regexp_replace(u, r"[{},]+", " ")), r"\s+")
    ))
    dotted = F.filter(F.transform(parts, lambda p: tx.normalize_dotted(F.replace(p, F.lit("::"), F.lit(".")))), lambda p: p != "")
    bare = F.transform(dotted, lambda p: F.regexp_replace(p, r"^(?:crate|self|super)\.", ""))
    return F.array_distinct(F.filter(
        F.concat(dotted, bare, F.transform(bare, tx.owner)), lambda p: p != ""
    ))


def called_in_text(text: Column) -> Column:
    calls = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*(?:::<[^>]+>\s*)?\("), F.lit(1))
    return F.array_distinct(F.transform(calls, tx.normalize_loose))


def fixture_args(text: Column) -> Column:
    found = F.flatten(F.transform(
        F.regexp_extract_all(text, F.lit(r"\bdef\s+test[\w_]*\s*\(([^)]*)\)"), F.lit(1)), lambda a: F.split(a, ",")
    ))
    names = F.transform(found, lambda a: tx.normalize_loose(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(a), r"^[*/]+", ""), r"\s*=.*$", ""), r"\s*:.*$", "")
    ))
    return F.array_distinct(F.filter(names, lambda n: ~n.isin("", "self", "cls")))


def parametrize_blocks(text: Column) -> Column:
    """Up to twelve lines from each ``parametrize``, to the test or a closing bracket."""
    lines = F.split(text, r"\r?\n")
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1).contains("parametrize"))

    def block(i: Column) -> Column:
        nothing = F.struct(F.lit(False).alias("done"), F.array().cast(EMPTY).alias("kept"))
        folded = F.aggregate(
            F.slice(lines, i, 12), nothing,
            lambda acc, s: F.when(acc["done"] | ((F.size(acc["kept"]) > 0) & s.rlike(r"^\s*(?:async\s+)?def\s+test")),
                                  F.struct(F.lit(True).alias("done"), acc["kept"].alias("kept")))
            .otherwise(F.struct(
                ((F.size(acc["kept"]) > 0) & s.rlike(r"^\s*\)\s*$")).alias("done"),
                F.concat(acc["kept"], F.array(s)).alias("kept"))),
        )
        return F.array_join(folded["kept"], "\n")

    return F.transform(starts, block)


def test_files(index) -> DataFrame:
    """Test files with body, imports, calls and symbols. The module chunk holds the whole body."""
    tests = index.files.filter("role = 'test'").select("file_id", "path")
    whole = index.units.filter("role = 'test' and kind = 'module' and name = path")
    body = whole.select("file_id", "chunk_id", "text")
    owner = index.symbols.select(F.col("symbol_id").alias("source_symbol_id"), "file_id").join(
        tests.select("file_id"), "file_id", "left_semi"
    )
    linked = index.edges.filter("kind in ('symbol_imports_module', 'symbol_calls_name')").select(
        "source_symbol_id", "target_name", "kind"
    ).join(owner, "source_symbol_id").groupBy("file_id").agg(
        F.collect_set(F.when(F.col("kind") == "symbol_imports_module", F.trim("target_name"))).alias("imports"),
        F.collect_set(F.when(F.col("kind") == "symbol_calls_name", F.trim("target_name"))).alias("calls"),
    )
    none = F.array().cast(EMPTY)
    joined = (
        tests.join(body, "file_id").join(ft.unit_tokens(whole).select("chunk_id", "tokens"), "chunk_id")
        .join(linked, "file_id", "left")
        .withColumn("imports", F.coalesce("imports", none)).withColumn("calls", F.coalesce("calls", none))
    )
    c = F.col
    return joined.select(
        "file_id", "path", "text",
        tx.normalize_loose(c("path")).alias("t_path"), F.lower("path").alias("low_path"),
        tx.normalize_loose(c("text")).alias("t_text"), tx.ascii_lower(c("text")).alias("low_text"),
        F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).alias("t_tokens"),
        F.transform("imports", lambda m: F.replace(F.lower(m), F.lit("."), F.lit(""))).alias("flat_imports"),
        F.array_distinct(F.concat(
            F.flatten(F.transform("imports", lambda m: import_variants(c("path"), m))),
            F.when(c("text").contains("use "), rust_uses(c("text"))).otherwise(none),
        )).alias("t_imports"),
        F.transform("calls", F.lower).alias("edge_calls"),
        F.array_distinct(F.concat(F.transform("calls", tx.normalize_loose), called_in_text(c("text")))).alias("t_calls"),
        F.when(c("text").contains("def test"), fixture_args(c("text"))).otherwise(none).alias("t_fixtures"),
        F.when(c("text").contains("parametrize"), parametrize_blocks(c("text"))).otherwise(none).alias("t_blocks"),
    ).withColumns({  # read for every pair, so they are made for each test once
        "t_layout": F.filter(
            F.split(tx.normalize_loose(F.regexp_replace("path", r"\.[^.]+$", "")), r"\s+"),
            lambda t: (F.length(t) >= 3) & ~t.isin(*LAYOUT_STOPWORDS)),
        "t_block_text": tx.normalize_loose(F.array_join("t_blocks", "\n")),
    })


def prepare_sources(sources: DataFrame, index) -> DataFrame:
    """Requests: source_id, source_file, symbol (nullable), terms, limit."""
    c = F.col
    indexed = (
        index.symbols.filter("kind = 'module'").join(index.files.select("file_id", "path"), "file_id")
        .filter("qualified_name != path")
        .join(index.symbols.select(c("symbol_id").alias("parent_symbol_id"), c("qualified_name").alias("parent_name")), "parent_symbol_id")
        .filter("parent_name = path")
        .groupBy(c("path").alias("source_file"))
        .agg(F.array_sort(F.collect_set(tx.normalize_dotted(c("qualified_name")))).alias("own_modules"))
    )
    none = F.array().cast(EMPTY)
    cleaned = sources.withColumn(
        "source_file", F.regexp_replace(F.replace("source_file", F.lit("\\"), F.lit("/")), r"^\./", "")
    )
    stem = tx.normalize_loose(tx.strip_extension(tx.basename(c("source_file"))))
    sym_leaf = tx.normalize_loose(F.element_at(
        F.filter(F.split("symbol", "[^A-Za-z0-9_]+"), lambda p: p != ""), -1))
    words = F.flatten(F.transform("terms", lambda t: F.split(tx.normalize_loose(t), r"\s+")))
    tokens = F.filter(F.split(tx.normalize_loose(c("source_file")), r"\s+"), lambda t: t != "")
    candidate = F.array_distinct(F.filter(
        tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*LAYOUT_STOPWORDS) & ~t.isin(*GENERIC_PATH_WORDS)))
    owner = F.when(c("symbol").contains("."), tx.owner(c("symbol"))).otherwise(c("symbol"))
    class_name = F.element_at(F.split(owner, r"::|\."), -1)
    dot_leaf = tx.normalize_loose(tx.leaf(c("symbol")))
    noun = F.when(
        dot_leaf.contains(" ") & F.substring_index(dot_leaf, " ", 1).isin(*NOUN_VERBS),
        F.regexp_replace(dot_leaf, r"^\S+\s+", ""),
    )
    return (
        cleaned.join(indexed, "source_file", "left")
        .withColumns({
            "stem": stem, "leaf": sym_leaf, "s_tokens": tokens,
            "modules": F.array_distinct(F.concat(F.coalesce("own_modules", none), module_names(c("source_file")))),
            "layout": F.array_distinct(F.filter(
                F.split(tx.normalize_loose(F.regexp_replace("source_file", r"\.[^.]+$", "")), r"\s+"),
                lambda t: (F.length(t) >= 3) & ~t.isin(*LAYOUT_STOPWORDS))),
            "l_terms": F.filter(F.transform("terms", tx.normalize_loose), lambda t: F.length(t) >= 2),
            "path_terms": F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(*LAYOUT_STOPWORDS))),
            "task_terms": F.slice(F.array_distinct(F.filter(
                words, lambda t: (F.length(t) >= 5) & ~t.isin(*LAYOUT_STOPWORDS))), 1, 3),
            "l_symbol": tx.normalize_loose(c("symbol")),
            "l_class": F.when(class_name.rlike("^[A-Z]"), tx.normalize_loose(class_name)),
            "fixture_names": F.array_distinct(F.filter(
                F.array_compact(F.array(stem, dot_leaf, noun)), lambda n: F.length(n) >= 3)),
            "wanted": F.coalesce("limit", F.lit(DEFAULT_LIMIT)),
        })
        .withColumn("cand_tokens", F.array_distinct(F.filter(
            F.concat(F.array("stem"), F.slice(candidate, 2, F.greatest(F.size(candidate), F.lit(1)))),
            lambda t: F.length(t) >= 3)))
        .withColumns({  # read for every pair
            "flat_modules": F.transform("modules", lambda m: F.replace(m, F.lit("."), F.lit(""))),
            "task_tokens": F.transform("task_terms", lambda t: F.concat(F.lit(" "), F.array_join(tx.fts_tokens(t), " "), F.lit(" "))),
        })
        .drop("own_modules")
    )


def _pieces(text: Column) -> Column:
    """All one- to three-character pieces of the words of a text."""
    def of_word(w: Column) -> Column:
        return F.flatten(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.array(F.substring(w, i, 1), F.substring(w, i, 2), F.substring(w, i, 3))))

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(F.split(text, r"\s+")), of_word)))


#: Up to so many (term, word) rows are sent to every task, so that the words of the texts are not shuffled.
MET_ROWS = 100_000


def holding(terms: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(term, keys) of every text that holds a term as a substring.

    ``terms``: term. ``texts``: keys, hay. A term goes by its longest word: the distinct
    words of the texts that can be it, or hold it where the term begins or ends, lead
    to the texts. That settles a term of one word; one of several is looked up in the
    texts found. Null terms and terms of white space find nothing.
    """
    term = F.col("term")
    parts, last = F.regexp_extract_all(term, F.lit(r"\S+"), F.lit(0)), F.size(F.regexp_extract_all(term, F.lit(r"\S+"), F.lit(0))) - 1
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(
        F.length(p).alias("n"), p.alias("part"), ((i == 0) & ~term.rlike(r"^\s")).alias("left"), ((i == last) & ~term.rlike(r"\s$")).alias("right"))))
    asked = terms.filter(term.rlike(r"\S")).select("term").distinct().select("term", longest.alias("x")).select(
        "term", "x.*", F.substring("x.part", 1, 3).alias("piece"))
    held = texts.select(*keys, F.explode(F.array_distinct(F.split("hay", r"\s+"))).alias("word")).filter("word != ''")
    vocabulary = held.select("word").distinct()
    word, part = F.col("word"), F.col("part")
    met = cut_lineage(
        vocabulary.select("word", F.explode(_pieces(word)).alias("piece")).join(asked, "piece")
        .filter(word.contains(part) & (F.col("left") | word.startswith(part)) & (F.col("right") | word.endswith(part)))
        .select("term", "word"))
    few = met.limit(MET_ROWS + 1).count() <= MET_ROWS
    found = held.join(F.broadcast(met) if few else met, "word").select("term", *keys).distinct()
    several = term.rlike(r"\s")
    if asked.filter(several).isEmpty():
        return found
    found = cut_lineage(found)
    verified = found.filter(several).join(texts, keys).filter(F.col("hay").contains(term)).select("term", *keys).distinct()
    return found.filter(~several).unionByName(verified)


def containing(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(source_id, file_id) where the file's text holds one of the source's needles."""
    keyed = needles.filter("needle is not null and trim(needle) != ''").select("source_id", F.col("needle").alias("term")).distinct()
    return holding(keyed, hay, ["file_id"]).join(keyed, "term").select("source_id", "file_id").distinct()


def pairs(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """(source_id, file_id) of tests that share any signal with a source."""
    c = F.col
    none = F.array().cast(EMPTY)
    # words that can make a signal only; a path like a name of several words holds its longest one
    longest = F.array_max(F.transform(F.split("leaf", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    shared = F.filter("s_tokens", lambda t: (F.length(t) >= 3) & ~t.isin(*LAYOUT_STOPWORDS))
    path_needles = F.concat(F.array("stem", longest), shared, "path_terms", "cand_tokens", "layout")
    text_needles = F.concat(F.array("l_symbol", "leaf", "l_class"), "l_terms", "fixture_names", "task_terms")
    by_path = containing(
        sources.select("source_id", F.explode(path_needles).alias("needle")),
        tests.select("file_id", F.concat_ws(" ", "t_path", "low_path").alias("hay")),
    )
    by_text = containing(
        sources.select("source_id", F.explode(text_needles).alias("needle")),
        tests.select("file_id", F.concat_ws(" ", "t_text", "t_tokens", "low_text").alias("hay")),
    )
    by_import = containing(
        sources.select("source_id", F.explode(F.transform("modules", lambda m: F.replace(m, F.lit("."), F.lit("")))).alias("needle")),
        tests.select("file_id", F.array_join("flat_imports", " ").alias("hay")),
    )
    # prefixes and suffixes of each imported name, and the parent of each module
    dotted = tests.select("file_id", F.explode("t_imports").alias("name")).withColumn("parts", F.split("name", r"\."))
    sizes = F.sequence(F.lit(1), F.size("parts"))
    names = dotted.select("file_id", F.explode(F.array_distinct(F.concat(
        F.transform(sizes, lambda i: F.array_join(F.slice("parts", 1, i), ".")),
        F.transform(sizes, lambda i: F.array_join(F.slice("parts", i, F.size("parts")), ".")),
    ))).alias("module"))
    modules = sources.select("source_id", F.explode(F.array_distinct(F.concat(
        "modules", F.filter(F.transform("modules", tx.owner), lambda m: m != "")))).alias("module"))
    by_name = names.join(modules, "module").select("source_id", "file_id")
    calls = tests.select("file_id", F.explode(F.array_distinct(F.concat("t_calls", "edge_calls"))).alias("leaf"))
    by_call = calls.join(sources.select("source_id", "leaf"), "leaf").select("source_id", "file_id")
    return by_path.unionByName(by_text).unionByName(by_import).unionByName(by_name).unionByName(by_call).distinct()


def imports_source() -> Column:
    """An import is the module, below it, or ends in it; or its parent with the stem in the body."""
    def one(m: Column) -> Column:
        direct = F.exists("t_imports", lambda i: (i == m) | i.startswith(F.concat(m, F.lit("."))) | i.endswith(F.concat(F.lit("."), m)))
        parent = tx.owner(m)
        return direct | ((parent != "") & F.array_contains("t_imports", parent) & F.col("t_text").contains(F.col("stem")))

    return F.exists("modules", one)


def signals() -> list[tuple[str, Column]]:
    """(reason, score) of every relation between a source and a test."""
    c = F.col

    def count(values: str, text: str) -> Column:
        return F.size(F.filter(values, lambda t: c(text).contains(t)))

    has_symbol = c("symbol").isNotNull()
    path_terms = count("path_terms", "t_path")
    shared = F.size(F.filter("s_tokens", lambda t: (F.length(t) >= 3) & ~t.isin(*LAYOUT_STOPWORDS) & c("t_path").contains(t)))
    mirrored = F.size(F.array_intersect("layout", "t_layout"))
    blocks = c("t_block_text")
    block_terms = F.size(F.filter("l_terms", lambda t: blocks.contains(t)))
    body_terms = count("l_terms", "t_text")
    controller = F.regexp_replace("stem", r"\s*controller$", "")
    rails = (
        c("path").rlike(r"^spec/requests/.*_spec\.rb$") & c("t_text").rlike("get|post|put|patch|delete")
        & (c("t_text").contains(F.concat(controller, F.lit(" path"))) | c("t_text").contains(F.concat(controller, F.lit(" url")))
           | c("t_text").contains(c("leaf")))
    )
    def when(test: Column, points) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)

    return [
        ("test path includes source stem", when(c("t_path").contains(c("stem")), 20)),
        ("test path matches task terms", F.least(8 * path_terms, F.lit(32))),
        ("test path shares source path tokens", F.least(4 * shared, F.lit(16))),
        ("test path mirrors source package layout", when(mirrored > 0, F.least(10 + 6 * mirrored, F.lit(22)))),
        ("test imports source module", when(imports_source(), 30)),
        ("test uses related fixture", when(
            F.exists("fixture_names", lambda n: c("t_text").contains(n)) & F.arrays_overlap("t_fixtures", "fixture_names"), 18)),
        ("parametrized cases match task terms", when(F.size("t_blocks") > 0, F.least(12 * block_terms, F.lit(36)))),
        ("parametrized cases mention source target", when(
            (F.size("t_blocks") > 0) & F.exists("fixture_names", lambda n: blocks.contains(n)), 16)),
        ("test body matches task terms", F.least(12 * body_terms, F.lit(84))),
        ("strong task-term coverage", when(body_terms >= 5, 24)),
        ("RSpec describes source symbol", when(has_symbol & c("t_text").contains(c("l_class")), 32)),
        ("request spec exercises Rails route", when(has_symbol & rails, 28)),
        ("test body mentions source symbol", when(
            has_symbol & (c("t_text").contains(c("l_symbol")) | c("t_text").contains(c("leaf"))), 24)),
        ("test calls source symbol", when(has_symbol & F.array_contains("t_calls", c("leaf")), 28)),
        ("test path includes symbol name", when(has_symbol & c("t_path").contains(c("leaf")), 36)),
    ]


def first_line() -> Column:
    """The first body line that shows a signal."""
    c = F.col
    lines = F.split("text", r"\r?\n")

    def useful(line: Column) -> Column:
        return tx.once(F.struct(tx.normalize_loose(line).alias("plain"), tx.normalize_dotted(line).alias("dotted")), shows)

    def shows(line: Column) -> Column:
        plain, dotted = line["plain"], line["dotted"]
        return (
            plain.contains(c("stem")) | F.exists("modules", lambda m: dotted.contains(m))
            | F.coalesce(plain.contains(c("leaf")), F.lit(False))
            | F.exists("l_terms", lambda t: plain.contains(t))
            | F.exists(F.filter("t_fixtures", lambda f: F.array_contains("fixture_names", f)), lambda f: plain.contains(f))
            | F.exists("t_blocks", lambda b: (plain != "") & (tx.normalize_loose(b).contains(plain) | plain.contains("parametrize")))
        )

    at = F.array_position(F.transform(lines, useful), True)
    return F.when(at > 0, at)


def candidate_flags() -> dict[str, Column]:
    """Membership in the pruned candidate set, without and with task terms."""
    c = F.col
    # a pattern is made for each pair it is asked of: only if the path holds the name's first word
    symbol_path = F.when(
        c("low_path").contains(F.substring_index("leaf", " ", 1)), F.expr("low_path like concat('%', replace(leaf, ' ', '%'), '%')")).otherwise(False)
    base = (
        F.exists("cand_tokens", lambda t: c("low_path").contains(t))
        | F.exists("flat_imports", lambda i: F.exists("flat_modules", lambda m: i.contains(m)))
        | F.coalesce(symbol_path, F.lit(False))
        | F.coalesce(F.array_contains("edge_calls", c("leaf")), F.lit(False))
    )
    has_terms = F.size("task_terms") > 0
    by_tokens = F.forall("task_tokens", lambda t: c("t_tokens").contains(t))
    by_text = F.forall("task_terms", lambda t: c("low_text").contains(t))
    return {"fast": base | (has_terms & by_tokens), "slow": base | (has_terms & by_text)}


def related_tests(index, sources: DataFrame) -> DataFrame:
    """The best tests of every source request.

    Pruned candidates are scored first; a request they do not fill takes all
    its tests into account.
    """
    prepared = cut_lineage(prepare_sources(sources, index).withColumn("source_row", F.monotonically_increasing_id()))
    tests = cut_lineage(test_files(index).withColumn("test_row", F.monotonically_increasing_id()))
    parts = signals()
    full = pairs(prepared, tests).join(prepared, "source_id").join(tests, "file_id")
    scored = full.withColumns({f"s_{i}": score for i, (_, score) in enumerate(parts)} | candidate_flags())
    total = sum((F.col(f"s_{i}") for i in range(len(parts))), F.lit(0))
    why = F.array_compact(F.array(*[F.when(F.col(f"s_{i}") > 0, reason) for i, (reason, _) in enumerate(parts)]))
    external = F.col("path").rlike("^(?:tests?|integration_tests?|functional_tests?|acceptance_tests?)/")
    slim = cut_lineage(
        scored.withColumn("raw", total).withColumn("why", why).select(
            "source_id", "source_row", "file_id", "test_row", F.col("path").alias("file"), "wanted", "fast", "slow",
            F.size("task_terms").alias("n_task"), "raw",
            (F.col("raw") + F.when(external, 24).otherwise(0)).cast("long").alias("score"),
            F.when(external, F.concat("why", F.array(F.lit("external test root")))).otherwise(F.col("why")).alias("why"),
        )
    )
    counts = slim.groupBy("source_id").agg(
        F.sum(F.col("fast").cast("int")).alias("n_fast"),
        F.sum((F.col("fast") & (F.col("raw") > 0)).cast("int")).alias("m_fast"),
        F.sum((F.col("slow") & (F.col("raw") > 0)).cast("int")).alias("m_slow"),
    )
    use_slow = (F.col("n_task") > 0) & (F.col("n_fast") < F.col("wanted"))
    enough = F.when(use_slow, F.col("m_slow")).otherwise(F.col("m_fast")) >= F.col("wanted")
    kept = slim.filter("raw > 0").join(counts, "source_id").filter(
        ~enough | F.when(use_slow, F.col("slow")).otherwise(F.col("fast"))
    )
    top = ft.best(kept, ["source_id"], [F.col("score").desc(), F.collate("file", "UNICODE")], F.col("wanted"))
    # lines are read for the best tests only, not for every pair; ids may repeat, rows do not
    best = cut_lineage(top.select("source_id", "source_row", "test_row", "position", "file_id", "file", "score", "why"))
    shown = best.join(prepared.drop("source_id"), "source_row").join(tests.drop("file_id", "path"), "test_row")
    return shown.select("source_id", "position", "file_id", "file", "score", "why", first_line().cast("long").alias("first_line"))


def merge_sources(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """Several sources of one question: the best score per test counts.

    ``groups`` maps source_id to group_id with ``limit``; the first source wins ties.
    """
    best = matches.join(groups, "source_id").groupBy("group_id", "file").agg(
        F.max_by(F.struct("score", "why", "first_line", "source_id"), F.struct("score", -F.col("source_id"))).alias("m"),
        F.first("limit").alias("wanted"),
    ).select("group_id", "file", "m.*", "wanted")
    return ft.best(best, ["group_id"], [F.col("score").desc(), F.collate("file", "UNICODE")], F.col("wanted")).drop("wanted")
