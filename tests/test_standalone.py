"""The library stands without its optional training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_the_optional_part(tmp_path, pipeline_too):
    gone = {"llm", "__pycache__", ".git"} | ({"corpus_pipeline.py"} if pipeline_too else set())
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda _d, names: [n for n in names if n in gone])
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in q))"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(out[0]) >= 112 and int(out[1]) >= 90 and out[2] == "False"
    listed = subprocess.run([sys.executable, "-m", "pytest", "tests/test_oracle.py", "--collect-only", "-q"], cwd=copy, env=env,
                            capture_output=True, text=True, timeout=300)
    assert listed.returncode == 0, listed.stdout[-500:]
