"""The engine stands without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_them(tmp_path):
    for name in ("plumbline", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert len(names) > 200 and not any(n.startswith('op') or n == 'pipeline' for n in names); assert set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_the_rest_passes_without_them(tmp_path):
    """A few of the other tests, in a copy that has no text operators; the driver runs all of them so."""
    for name in ("plumbline", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    chosen = ["tests/test_dialect.py::test_translation_is_text_only", "tests/test_plans.py::test_entry_gives_rows", "tests/test_plans.py::test_every_query_has_an_oracle"]
    subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", *chosen], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_what_is_broken_inside_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "plumbline/llm").mkdir()
    (tmp_path / "plumbline/llm/__init__.py").touch()
    (tmp_path / "corpus_pipeline.py").write_text("import nothing_of_this_name\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode and "nothing_of_this_name" in done.stderr


def test_nothing_else_imports_them():
    for path in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "plumbline.llm" not in path.read_text(), path
