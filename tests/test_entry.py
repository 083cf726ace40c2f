"""The driver's contract, and that the core stands without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_part(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q05_scan_latest' in q and not any(k.startswith('op') for k in q), q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=to, env=env).returncode == 0


def test_a_fault_in_the_optional_part_is_not_hidden(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    (to / "tidemark/llm").mkdir()
    (to / "tidemark/llm/__init__.py").write_text("")
    (to / "tidemark/llm/queries.py").write_text("import no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=to, env=env, capture_output=True).returncode != 0
