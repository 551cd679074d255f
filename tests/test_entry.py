"""The driver's entry point, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 60 and set(o) <= set(q) and not any(k.startswith("op") and k[2].isdigit() for k in q) and "pipeline" not in q
assert callable(e.entry)
"""


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for gone in ("partlab/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    for there in (True, False):
        if not there and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_every_query_with_sql_is_registered():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
