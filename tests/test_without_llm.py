"""The library and its queries without the folder of training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, copy, ignore=left_out)
    code = (
        "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); "
        "assert 'r21_revenue_report' in q and set(o) <= set(q), sorted(q); "
        "assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
