"""The entry on copies of the repository that lack the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"


@pytest.mark.parametrize("gone", [["lexmill/llm"], ["lexmill/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *(os.path.basename(g) for g in gone)))
    got = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)}, check=False)
    assert got.returncode == 0, got.stderr
    queries, sql, pipeline, corpus = got.stdout.split()
    assert int(queries) > 190 and int(sql) > 180
    assert pipeline == "False"
    assert corpus == str("lexmill/llm" not in gone and os.path.isdir(os.path.join(ROOT, "lexmill/llm")))
