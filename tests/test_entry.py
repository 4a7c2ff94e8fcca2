"""The entry points without the packages that only the training-data operators need, and without their folders."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
names = entry.queries()
print(len(names), sum(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names, sorted(set(entry.oracle_sql()) - set(names)))
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "sentencepiece", "tokenizers", "twinspark.llm", "corpus_pipeline"])
def test_other_queries_load(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])})
    count, operators, pipeline, more = done.stdout.split(" ", 3)
    assert int(count) > 118 and more.strip() == "[]"
    if name in ("public_tokenizers", "twinspark.llm"):
        assert operators == "0"
    if name in ("corpus_pipeline", "twinspark.llm"):
        assert pipeline == "False"


def test_own_errors_are_not_hidden():
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name="twinspark.operators.similar")], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode and "twinspark.operators.similar" in done.stderr
