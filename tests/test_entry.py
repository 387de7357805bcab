"""The entry point stands with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.oracle_sql()) > 60


def test_without_corpus_operators(tmp_path):
    """Everything but the corpus operators imports after they are gone."""
    for p in ("rivulet", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path / p)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "rivulet/llm")], check=True)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout) > 60
