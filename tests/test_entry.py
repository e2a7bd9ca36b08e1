"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT

_LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q), set(o) <= set(q))"


def listed(folder) -> list[str]:
    env = os.environ | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-B", "-c", _LIST], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_queries_without_the_optional_parts(tmp_path):
    """Gone, or left over as an empty folder, which counts as a namespace package."""
    shutil.copytree(f"{ROOT}/rankweave", tmp_path / "rankweave", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    bare = listed(tmp_path)
    assert int(bare[0]) >= 194 and bare[2:] == ["False", "True"]
    (tmp_path / "rankweave/llm/__pycache__").mkdir(parents=True)
    (tmp_path / "corpus_pipeline.py").write_text("import rankweave.llm.bpe\n")
    assert listed(tmp_path) == bare
