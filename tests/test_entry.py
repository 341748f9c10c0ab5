"""The contract holds with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(REPO / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()) > 40, any(n.startswith('op') for n in e.queries()), 'point_in_time_pbr' in e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False", "True"], out.stderr
