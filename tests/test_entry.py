"""The entry without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def _names(folder):
    env = {**os.environ, "PYTHONPATH": folder}
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "tests")
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(ROOT, copy, ignore=skip)
        if not pipeline and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        queries, twins, has_pipeline = _names(str(copy))
        assert int(queries) > 150 and int(twins) > 150 and has_pipeline == "False"
