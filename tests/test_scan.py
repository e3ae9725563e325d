from codelode.plans import task
from codelode.sources import scan


TREE = {
    ".gitignore": "# rules\nskip.*\n/logs/\n*.gen.py\n!b.gen.py\n", "pkg/.gitignore": "keep.py\n!keep.py\nonly/\n!a.gen.py\n",
    "wt/.git": "gitdir: /r/.git/worktrees/wt\n",
} | dict.fromkeys((
    "a.py", "pkg/__init__.py", "pkg/skip.py", "pkg/keep.py", "node_modules/x.js", "logs/y.py", "sub/logs/y.py", "tests/t.py", "wt/z.py",
    "a.gen.py", "b.gen.py", "pkg/a.gen.py", "pkg/only/x.py", "pkg/deep/only/x.py", "pkg/only.py", "logs/.gitignore",
), "x = 1\n")
KEPT = {"a.py", "pkg/__init__.py", "pkg/keep.py", "sub/logs/y.py", "tests/t.py", "b.gen.py", "pkg/a.gen.py", "pkg/only.py"}


def test_tree_and_table_prune_alike(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = {r["path"] for r in scan.read_tree(spark, str(tmp_path)).collect()}
    table = {r["path"] for r in scan.from_table(spark.createDataFrame(list(TREE.items()), "path string, text string")).collect()}
    assert tree == table == KEPT
    assert {r["path"] for r in scan.list_tree(spark, str(tmp_path), source_only=True).collect()} & set(TREE) >= KEPT - {"tests/t.py"}
    assert scan.from_table(spark.createDataFrame([("a.py", "")], "path string, text string")).count() == 1


def test_read_tree(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/__init__.py").write_text("import os\n")
    (tmp_path / "notes.txt").write_text("no")
    rows = scan.read_tree(spark, str(tmp_path)).collect()
    assert [(r["path"], r["language"], r["role"], r["text"]) for r in rows] == [("m/__init__.py", "python", "source", "import os\n")]


def test_task_plans():
    t = task.Task(("disable", "default"))
    assert [s.purpose for s in task.plan_task("bugfix", t)] == ["source-map", "implementation-context", "related-tests"]
    assert task.expand_vocabulary(t.terms)[-2:] == ("resolve", "decision")
