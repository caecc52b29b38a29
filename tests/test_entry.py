"""What the entry leaves out, and what it does not."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def said(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=False)


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/erascope", tmp_path / "erascope", ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


def test_without_the_optional_parts(copy):
    whole = said(copy)
    assert whole.returncode == 0
    shutil.rmtree(copy / "erascope/llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    rest = said(copy)
    assert rest.returncode == 0, rest.stderr[-500:]
    n, optional = map(int, rest.stdout.split())
    assert optional == 0 and n == int(whole.stdout.split()[0]) - int(whole.stdout.split()[1])


def test_a_mistyped_import_is_no_missing_part(copy):
    if not (copy / "erascope/llm/registry.py").exists():
        pytest.skip("the optional parts are not here")
    with open(copy / "erascope/llm/registry.py", "a") as f:
        f.write("\nfrom .no_such_module import x\n")
    assert said(copy).returncode != 0
