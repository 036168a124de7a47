"""The queries stand without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q); print(sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_without_the_subpackage(tmp_path, also):
    shutil.copytree(ROOT, tmp_path / "r", ignore=lambda d, names: [n for n in names if n in {".git", "llm", "__pycache__", *also}])
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "r", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == ["0", "False"]
