"""The entry point without packages or folders that only the training-data operators need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
print("r3_hybrid_search" in entry.queries(), any(n.startswith("op") for n in entry.queries()))
"""


def run(names):
    return subprocess.run([sys.executable, "-c", HIDE.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("names", [("tiktoken",), ("lodestone.llm",), ("corpus_pipeline",)])
def test_library_without(names):
    assert run(names).stdout.split() == ["True", "False"]


@pytest.mark.parametrize("name", ["lodestone.operators.joins", "lodestone.plans.retrieval"])
def test_a_missing_module_of_the_library_is_a_mistake(name):
    found = run((name,))
    assert found.returncode and name.rpartition(".")[2] in found.stderr
