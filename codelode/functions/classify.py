"""File language and role from a path, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.functions.text import basename

# Directory names and file endings with a meaning.
IGNORED_DIRS = (
    ".git", ".worktrees", ".hg", ".svn", ".venv", "venv", "node_modules", "dist", "build",
    "coverage", "target", ".next", ".codeindex", ".codelode", "__pycache__",
)
SUPPORT_DIRS = (
    "tests", "test", "__tests__", "spec", "specs", "_tests", "type_tests", "testing",
    "tools", "tool", "_tools", "scripts", "worked", "docs", "docs_src", "examples", "example",
    "benchmarks", "benchmark", "asv_benchmarks", "benches", "fixtures", "fixture", "samples", "sample",
)
TEST_DIRS = (
    "tests", "test", "__tests__", "spec", "specs", "_tests", "type_tests", "testing", "integration_test",
)
DOCS_DIRS = ("docs", "docs_src")
EXAMPLE_DIRS = ("examples", "example", "samples", "sample")
FIXTURE_DIRS = ("fixtures", "fixture")
TOOL_DIRS = ("tools", "tool", "_tools", "scripts", "worked")
BENCHMARK_DIRS = ("benchmarks", "benchmark", "asv_benchmarks", "benches")
ARTIFACT_FILES = ("benchmark.json", "graphify-results.json", "navigation-eval.json", "suite.json")
ROLES = ("source", "test", "docs", "example", "fixture", "tool", "benchmark")
LANGUAGE_ENDINGS = {
    "python": (".py",),
    "go": (".go",),
    "rust": (".rs",),
    "cpp": (".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx", "BUILD", "BUILD.bazel"),
    "c": (".c", ".h", ".mk", "Makefile", "CMakeLists.txt", "meson.build"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "json": (".json",),
    "dart": (".dart",),
    "cython": (
        ".pyx", ".pxd", ".pxi", ".pyx.tp", ".pxd.tp", ".pxi.tp", ".pyx.in", ".pxd.in", ".pxi.in",
    ),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "java": (".java",),
    "ruby": (".rb", ".rake", ".gemspec", ".feature", "Gemfile", "Rakefile", "config.ru", "rails"),
    "php": (".php",),
    "csharp": (".cs",),
    "xml": (".xml",),
    "toml": (".toml",),
    "yaml": (".yaml", ".yml"),
}
TEST_FILE_PATTERN = "|".join((
    r"\.(?:test|spec)\.[cm]?[jt]sx?$",
    r"_test\.go$",
    r"(?:^test_|_test|_tests|tests)\.rs$",
    r"(?:^test_|_test|_tests|Test|Tests)\.[ch]$",
    r"(?:^test_|_test|_tests|Test|Tests)\.(?:cc|cpp|cxx|hpp|hh|hxx|h)$",
    r"(?:^test_|_test)(?:[A-Za-z0-9_]*)(?:\.pyx|\.pxd|\.pxi)(?:\.(?:tp|in))?$",
    r"Tests\.swift$",
    r"(?:Test|Tests|Spec)\.kts?$",
    r"(?:Test|Tests|IT|ITCase)\.java$",
    r"(?:Test|Tests|Spec)\.php$",
    r"(?:Test|Tests|Spec|Specs|Fixture|Fixtures|IT)\.cs$",
    r"_test\.dart$",
))

def _any(names: tuple[str, ...]) -> str:
    return "(?:" + "|".join(name.replace(".", r"\.") for name in names) + ")"


def matched_ending(path: Column) -> Column:
    """The longest known ending of the file name, empty for files that are not indexed.

    The leftmost match of an end-anchored alternation is the longest ending.
    """
    endings = tuple(e for group in LANGUAGE_ENDINGS.values() for e in group)
    return F.regexp_extract(basename(path), f"({_any(endings)})$", 1)


def language(path: Column, text: Column) -> Column:
    """Language by ending, with a content look for C++ headers and build files."""
    pairs = [F.lit(v) for lang, group in LANGUAGE_ENDINGS.items() for e in group for v in (e, lang)]
    ending = matched_ending(path)
    cpp_header = text.rlike(r"\b(class|namespace|template|public|private|protected)\b") | text.rlike(
        r"\bstd::|[A-Za-z_][A-Za-z0-9_]*::[A-Za-z_~]"
    )
    cpp_build = text.rlike(r"\.(cc|cpp|cxx|hpp|hh|hxx)\b") | text.rlike(r"\bcc_(library|binary|test)\b|\bCXX\b")
    return (
        F.when((ending == ".h") & cpp_header, "cpp")
        .when(ending.isin("CMakeLists.txt", "meson.build") & cpp_build, "cpp")
        .otherwise(F.try_element_at(F.create_map(*pairs), ending))
    )


def _support_segment(path: Column, names: tuple[str, ...]) -> Column:
    """A segment of the given names outside the package path below a ``src`` directory.

    Below ``src`` such names are packages of JVM and .NET projects; only a last
    segment directly inside ``src`` still counts.
    """
    outside = rf"^(?:(?!src/)[^/]+/)*{_any(names)}(?:/|$)"
    last = rf"(?:^|/)src/{_any(names)}$"
    return path.rlike(outside) | path.rlike(last)


def role(path: Column) -> Column:
    """One of seven roles; tests win over docs, examples, fixtures, tools, benchmarks."""
    name = basename(path)
    is_test = (
        path.rlike(rf"^t(?:/|$)|(?:^|/){_any(TEST_DIRS)}(?:/|$)|/src/(?:tests?|androidTest)/")
        | (path.startswith("features/") & name.endswith(".feature"))
        | name.rlike(TEST_FILE_PATTERN)
        | path.rlike(r"(?i)\.(?:tests?|specs?|unittests?|integrationtests?)(?:/|$)")
    )
    return (
        F.when(is_test, "test")
        .when(_support_segment(path, DOCS_DIRS), "docs")
        .when(_support_segment(path, EXAMPLE_DIRS), "example")
        .when(_support_segment(path, FIXTURE_DIRS), "fixture")
        .when(path.startswith("bin/") & (name != "console"), "tool")
        .when(_support_segment(path, TOOL_DIRS), "tool")
        .when(_support_segment(path, BENCHMARK_DIRS), "benchmark")
        .otherwise("source")
    )


def in_ignored_dir(path: Column) -> Column:
    return path.rlike(rf"(?:^|/){_any(IGNORED_DIRS)}/")


def in_support_dir(path: Column) -> Column:
    """Directories a source-only index leaves out."""
    return path.rlike(rf"^t/|(?:^|/){_any(SUPPORT_DIRS)}/")


def is_artifact(path: Column) -> Column:
    """Evaluation result files, and C# build output."""
    name = basename(path)
    generated = name.endswith(".cs") & path.rlike(r"(?:^|/)(?:bin|obj)/")
    return name.isin(*ARTIFACT_FILES) | name.endswith("-benchmark.json") | generated
