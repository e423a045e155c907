"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_the_rest_works_without_the_subpackage(tmp_path):
    kept = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=kept)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) < set(q) and len(q) > 60 and all(n.startswith('q') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout
    # those that need no session are run as well
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_kernels.py", "tests/test_trellis.py", "tests/test_alignment.py", "--deselect", "tests/test_alignment.py::test_batches_are_ten_times_as_fast"], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0 and " passed" in ran.stdout, ran.stdout


def test_nothing_else_imports_the_subpackage():
    for folder in ("functions", "operators", "sources", "streaming", "plans"):
        for base, _, names in os.walk(os.path.join(ROOT, "phonolith", folder)):
            for name in names:
                if name.endswith(".py"):
                    assert "phonolith.llm" not in open(os.path.join(base, name), encoding="utf-8").read()
