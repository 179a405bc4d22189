import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def imported(folder, code):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.fixture
def without(tmp_path):
    """A copy of the repository without the training-data operators and their pipeline."""
    return Path(shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "*.json")))


def test_everything_else_works_without_llm(without):
    out = imported(without, "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(s) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline'], q")
    assert out.returncode == 0, out.stderr
    (without / "blobloom/llm").mkdir()
    assert imported(without, "import __spark_entry__ as e; assert len(e.queries()) > 60").returncode == 0


def test_a_broken_dependency_is_no_absence(without):
    (without / "blobloom/llm").mkdir()
    (without / "blobloom/llm/__init__.py").write_text("")
    (without / "blobloom/llm/registry.py").write_text("import a_library_that_is_not_there\n")
    out = imported(without, "import __spark_entry__")
    assert out.returncode != 0 and "a_library_that_is_not_there" in out.stderr
    (without / "blobloom/llm/registry.py").write_text("from numpy import no_such_thing\n")
    assert imported(without, "import __spark_entry__").returncode != 0
