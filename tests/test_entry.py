"""The entry points also work where the optional package is missing."""

import subprocess
import sys
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
MISSING = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {names} or name.startswith("siftrank.llm."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
names = set(entry.queries())
assert "bm25_single" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(entry.oracle_sql()) <= names
"""


def test_without_the_optional_package():
    for names in ({"siftrank.llm", "corpus_pipeline"}, {"siftrank.llm"}):
        code = MISSING.format(names=names, root=ROOT)
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
