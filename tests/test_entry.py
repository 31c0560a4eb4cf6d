"""The entry module with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'who_calls' in q; print(len(q), 'pipeline' in q, sum(k.startswith('op') for k in q))"


def ask(folder):
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"}).stdout.split()


def copied(tmp_path, *gone):
    shutil.copytree(ROOT, tmp_path, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse", *gone))
    return ask(tmp_path)


def test_entry_without_the_optional_part(tmp_path):
    for k, gone in enumerate(((), ("corpus_pipeline.py",))):
        n, pipeline, ops = copied(tmp_path / f"r{k}", *gone)
        assert int(n) >= 40 and pipeline == "False" and ops == "0"
    if (ROOT / "skeingraph/llm/__init__.py").exists():
        assert ask(ROOT)[1:] == ["True", "10"]


def test_other_missing_modules_are_errors(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse", "corpus_pipeline.py"))
    (tmp_path / "r/skeingraph/llm").mkdir()
    (tmp_path / "r/skeingraph/llm/__init__.py").touch()
    (tmp_path / "r/skeingraph/llm/queries.py").write_text("import no_such_module\n")
    with pytest.raises(subprocess.CalledProcessError) as e:
        ask(tmp_path / "r")
    assert "no_such_module" in e.value.stderr


def test_nothing_else_imports_it():
    for p in [*(ROOT / "skeingraph").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in p.relative_to(ROOT).parts:
            assert "skeingraph.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
