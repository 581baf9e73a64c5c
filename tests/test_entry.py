"""The driver's contract, with and without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["event_id", "market", "stream", "event_time_ns", "unreliable", "place"] and out.count() > 0


def test_every_core_query_has_sql():
    from tidemark.plans import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_imports_without_the_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n == 'pipeline' for n in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)


def test_nothing_else_imports_the_text_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "tidemark")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert "llm" not in f.read()
