from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert df.columns == __spark_entry__.entry(spark).columns


def test_sql_only_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "quillstream", tmp_path / "quillstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    count, *flags = said.stdout.split()
    assert int(count) > 80 and flags == ["False", "False", "True"]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quillstream").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
