import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['codelode', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
if sys.argv[1] == 'gone':
    sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""


def names(state):
    out = subprocess.run([sys.executable, "-c", CODE, state], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout


def test_works_without_the_optional_part():
    out = names("gone")
    assert out.startswith("[] ") and out.strip().endswith("True")


def test_registers_the_optional_part():
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        out = names("whole")
        assert all(f"'op{n}_" in out for n in range(1, 11)) and "'pipeline'" in out and out.strip().endswith("True")
