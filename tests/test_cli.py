import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(*args, code=0):
    out = subprocess.run([sys.executable, "-m", "codelode.cli", *args], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert out.returncode == code, out.stderr[-2000:]
    return [json.loads(line) for line in out.stdout.splitlines() if line.startswith("{")]


def test_query_in_a_fresh_process(tmp_path):
    tree = tmp_path / "tree"
    (tree / "shop").mkdir(parents=True)
    (tree / "shop" / "cart.py").write_text("class Cart:\n    def total(self):\n        return sum(self.items)\n\n    def add_item(self, item):\n        self.items.append(item)\n")
    (tree / "shop" / "mail.py").write_text("def send_mail(cart):\n    return cart.total()\n")
    where = str(tmp_path / "index")
    run("index", "--target", str(tree), "--index-path", where)
    for mode in ("symbol", "fts", "hybrid"):
        rows = run("query", "total cart", "--target", str(tree), "--index-path", where, "--mode", mode, "--path-hint", "shop/cart.py")
        assert rows and rows[0]["file"] == "shop/cart.py", mode
    hard = run("query", "total cart", "--target", str(tree), "--index-path", where, "--path-hint", "mail", "--path-mode", "filter")
    assert {r["file"] for r in hard} == {"shop/mail.py"}

    # the class and its method both hold the words of the first question
    questions = [{"id": i, "question": q, "expected": {"files": ["shop/cart.py"], "symbols": names}}
                 for i, q, names in (("q1", "Cart total", ["Cart", "Cart.total"]), ("q2", "send_mail", ["Gone"]), ("q3", "add_item", ["add_item"]))]
    asked, answers = tmp_path / "questions.json", tmp_path / "answers.json"
    asked.write_text(json.dumps(questions))
    answers.write_text(json.dumps([{"id": "q1", "text": "see cart.total() in shop/cart.py"}, {"id": "q2", "text": "Gone"}]))
    here = ("--target", str(tree), "--index-path", where)
    rows = {r["id"]: r for r in run("agent-eval", str(asked), "--answers", str(answers), *here)}
    assert rows["q1"]["winner"] == "tie" and rows["q1"]["file_mention"]
    assert rows["q2"]["winner"] == "answers" and rows["q3"]["winner"] == "index"
    assert {r["winner"] for r in run("agent-eval", str(asked), *here)} == {"inconclusive"}


def test_compare_runs(tmp_path):
    before, after = tmp_path / "before.json", tmp_path / "after.json"
    before.write_text(json.dumps([{"cases": 3, "completion_rate": 1.0, "avg_context_tokens": 10}, {"name": "r", "completion_rate": 0.5}]))
    after.write_text(json.dumps([{"cases": 3, "completion_rate": 1.0, "avg_context_tokens": 12}]))
    rows = run("nav-compare", str(before), str(after), code=1)
    assert [(r["name"], r["metric"], r["rule"]) for r in rows] == [("", "avg_context_tokens", "budget"), ("r", "name", "missing")]
    assert run("nav-compare", str(before), str(before)) == []
