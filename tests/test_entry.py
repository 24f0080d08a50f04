"""The entry module with and without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOWN = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("without_pipeline", [True, False])
def test_the_library_works_without_the_optional_package(tmp_path, without_pipeline):
    for name in ("millrace", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if not source.exists() or (name == "corpus_pipeline.py" and without_pipeline):
            continue
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    run = subprocess.run([sys.executable, "-B", "-c", SHOWN], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    total, optional, pipeline, checked = run.stdout.split()
    assert int(total) > 150 and (optional, pipeline, checked) == ("0", "False", "True")
