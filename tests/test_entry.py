"""The driver's contract, and the library without its removable part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 40


def test_it_imports_without_the_removable_part(tmp_path):
    import shutil

    for name in ("__spark_entry__.py", "statemesh"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "statemesh" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'relation_by_axis' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert {r["relation"] for r in rows} >= {"corroboration", "reconciled", "ambiguous"}
