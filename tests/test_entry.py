import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

from tidewatch.plans import queries as monitoring

ROOT = Path(__file__).resolve().parent.parent


def test_each_monitoring_query_has_a_twin():
    assert monitoring.QUERIES.keys() == monitoring.ORACLE_SQL.keys()
    assert set(monitoring.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries(); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PYTHONPATH": str(tmp_path), "PATH": ""})


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "tidewatch").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tidewatch.llm" not in path.read_text()
