"""The entry module with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "tallyscan.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""


def test_imports_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, check=True)
    from tallyscan.plans.oracle import ORACLES
    from tallyscan.plans.queries import QUERIES

    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


def test_nothing_else_imports_it():
    for file in [*ROOT.glob("tallyscan/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in file.parts and file.name != "test_entry.py":
            assert "tallyscan.llm" not in file.read_text()
