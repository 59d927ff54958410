"""The library without its corpus part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(set(s) - set(q)), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("gone", [("folioflow/llm",), ("folioflow/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_corpus_part(tmp_path, gone):
    for name in ("folioflow", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=lambda d, names: [n for n in names if n == "__pycache__" or os.path.relpath(os.path.join(d, n), REPO) in gone])
        elif source.exists() and name not in gone:
            shutil.copy(source, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, unknown, corpus = map(int, out.stdout.split())
    assert n > 100 and unknown == 0 and (corpus == 0 or "folioflow/llm" not in gone)
