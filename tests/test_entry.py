"""The entry module without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = """
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert len(names) > 80 and sql <= names, sql - names
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
import weblathe.cli, weblathe.plans.scan, weblathe.streaming.stateful
"""


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
