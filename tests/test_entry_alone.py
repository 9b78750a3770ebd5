"""The library without its optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_optional_parts(tmp_path, gone):
    skip = shutil.ignore_patterns(".git", "__pycache__", *gone)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = ("import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); "
            "print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q))")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, pipeline, corpus = done.stdout.split()
    assert int(count) > 50 and pipeline == "False" and corpus == str("llm" not in gone)


def test_a_pipeline_elsewhere_on_the_path_is_not_registered(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; print('pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(ROOT)})
    assert done.returncode == 0 and done.stdout.split()[-1] == "False", done.stderr
