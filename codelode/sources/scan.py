"""Source trees as DataFrames.

``read_tree`` lists folders in tasks, level by level: the folders of one level are
rows that carry the ignore rules of all folders above them, so the driver holds no
path. Contents are read in tasks too; Spark's own file sources skip names that start
with an underscore or a dot, which would lose ``__init__.py``. Tables of (path, text)
are read with ``from_table``, which applies the ignore files and linked worktrees
among their rows by joins.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import classify
from codelode.session import cut_lineage


def glob_regex(pattern: str) -> str:
    """A gitignore glob as a regular expression: ``**``, ``*`` and ``?``."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return out


def parse_gitignore(text: str, folder: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern, negated, directories only) per rule, relative to ``folder``."""
    rules = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))
        prefix = re.escape(folder + "/") if folder else ""
        rules.append((re.compile(prefix + ("" if anchored else "(?:.*/)?") + body + "$"), negated, only_dirs))
    return rules


def is_ignored(path: str, is_dir: bool, rules) -> bool:
    """The last matching rule decides."""
    verdict = False
    for pattern, negated, only_dirs in rules:
        if (is_dir or not only_dirs) and pattern.match(path):
            verdict = not negated
    return verdict


def linked_worktree(folder: str) -> bool:
    """A folder whose ``.git`` file points into another repository's worktrees."""
    marker = os.path.join(folder, ".git")
    if not os.path.isfile(marker):
        return False
    with open(marker, encoding="utf-8", errors="replace") as handle:
        head = handle.read()
    return head.startswith("gitdir:") and "/.git/worktrees/" in head.replace("\\", "/")


def list_folder(root: str, folder: str, above: list[dict], source_only: bool) -> Iterator[tuple[str, bool, list[dict]]]:
    """(path, is a folder, ignore files from the root to here) of what a folder holds; pruned folders are left out.

    ``above``: the ignore files of the folders above, as {folder, text}.
    """
    absolute = os.path.join(root, folder)
    marker = os.path.join(absolute, ".gitignore")
    held = list(above)
    if os.path.isfile(marker):
        with open(marker, encoding="utf-8", errors="replace") as handle:
            held.append({"folder": folder, "text": handle.read()})
    rules = [rule for one in held for rule in parse_gitignore(one["text"], one["folder"])]
    with os.scandir(absolute) as entries:
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False):
                support = source_only and (entry.name in classify.SUPPORT_DIRS or path == "t")
                if not (entry.name in classify.IGNORED_DIRS or support or is_ignored(path, True, rules) or linked_worktree(entry.path)):
                    yield path, True, held
            elif entry.is_file() and not is_ignored(path, False, rules):
                yield path, False, []


def list_tree(spark: SparkSession, root: str, source_only: bool = False) -> DataFrame:
    """path of every file below a folder all executors can read; one round for each level of folders."""
    if not os.path.isdir(root):
        raise NotADirectoryError(f"{root} is not a directory")
    schema = "path string, folder boolean, rules string"  # rules: the ignore files above, as JSON

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rules in zip(batch["path"], batch["rules"]):
                found = list(list_folder(root, path, json.loads(rules), source_only))
                yield pd.DataFrame({
                    "path": pd.Series([f[0] for f in found], dtype=object), "folder": pd.Series([f[1] for f in found], dtype=bool),
                    "rules": pd.Series([json.dumps(f[2]) for f in found], dtype=object),
                })

    level = spark.createDataFrame([("", True, "[]")], schema)
    files = level.filter("not folder").select("path")
    while True:
        listed = cut_lineage(level.mapInPandas(enter, schema))
        files = files.unionByName(listed.filter("not folder").select("path"))
        level = listed.filter("folder").repartition("path")
        if level.isEmpty():
            return files


def read_tree(spark: SparkSession, root: str, source_only: bool = False) -> DataFrame:
    """(path, text) of the files worth indexing below a folder all executors can read."""
    paths = list_tree(spark, root, source_only)
    wanted = paths.filter((classify.matched_ending(F.col("path")) != "") & ~classify.is_artifact(F.col("path")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:  # a text at a time
                with open(os.path.join(root, path), "rb") as handle:
                    yield pd.DataFrame({"path": [path], "text": [handle.read().decode("utf-8", errors="replace")]})

    spread = wanted.repartition(spark.sparkContext.defaultParallelism)
    return _described(spread.mapInPandas(read, "path string, text string"), source_only)


def table_rules(files: DataFrame) -> DataFrame:
    """(folder, depth, line, pattern, negated, only_dirs) of every rule in the ignore files of a table."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["folder", "depth", "line", "pattern", "negated", "only_dirs"]
        for batch in batches:
            for folder, text in zip(batch["folder"], batch["text"]):
                rules = parse_gitignore(text, folder)
                yield pd.DataFrame([
                    (folder, folder.count("/") + bool(folder), i, "^" + pattern.pattern, negated, only)
                    for i, (pattern, negated, only) in enumerate(rules)
                ], columns=columns)

    named = files.filter(F.substring_index("path", "/", -1) == ".gitignore").select(
        F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), "text")
    return named.mapInPandas(parse, "folder string, depth int, line int, pattern string, negated boolean, only_dirs boolean")


def pruned_paths(files: DataFrame) -> DataFrame:
    """Paths of a table that its ignore files or linked worktrees take out.

    A path meets the rules of the folders above it by an equi-join on the folder.
    The last matching rule decides, for the path and for each folder above it.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    opened = files.select("path", F.explode(above).alias("folder"))
    targets = opened.select("path", F.explode(F.array("folder", "path")).alias("target")).filter("target != ''").distinct()
    meets = opened.join(table_rules(files), "folder").join(targets, "path").filter(
        (F.col("target") != F.col("folder")) & (F.startswith("target", F.concat("folder", F.lit("/"))) | (F.col("folder") == ""))
        & (~F.col("only_dirs") | (F.col("target") != F.col("path"))) & F.rlike("target", F.col("pattern"))
    )
    last = meets.groupBy("path", "target").agg(F.max_by(~F.col("negated"), F.struct("depth", "line")).alias("ignored"))
    marker = F.replace(F.col("text"), F.lit("\\"), F.lit("/"))
    trees = files.filter(
        (F.substring_index("path", "/", -1) == ".git") & F.col("path").contains("/")
        & marker.startswith("gitdir:") & marker.contains("/.git/worktrees/")
    ).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return last.filter("ignored").select("path").unionByName(opened.join(trees, "folder").select("path")).distinct()


def from_table(files: DataFrame, source_only: bool = False) -> DataFrame:
    """(path, text, language, role, hash) of indexable files in a (path, text) table, without what its ignore files name."""
    return _described(files.join(pruned_paths(files), "path", "left_anti"), source_only)


def _described(files: DataFrame, source_only: bool) -> DataFrame:
    path = F.col("path")
    kept = files.filter(
        (classify.matched_ending(path) != "") & ~classify.in_ignored_dir(path) & ~classify.is_artifact(path)
    )
    if source_only:
        kept = kept.filter(~classify.in_support_dir(path))
    return kept.select(
        "path", "text", classify.language(path, F.col("text")).alias("language"),
        classify.role(path).alias("role"), F.sha2("text", 256).alias("hash"),
    )
