"""The driver's entry point, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parents[1]


def names_in(home: Path) -> list[str]:
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=home, env=os.environ | {"PYTHONPATH": str(home)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(HOME, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    names = names_in(tmp_path / "r")
    assert "window_1h" in names and "slo_alerts" in names
    assert not [n for n in names if n[:2] == "op" and n[2].isdigit()] and "pipeline" not in names


def test_nothing_else_imports_the_subpackage():
    for path in (HOME / "sloscope").rglob("*.py"):
        if "llm" not in path.relative_to(HOME).parts:
            assert "sloscope.llm" not in path.read_text(), path


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 8 and "success_ratio" in df.columns
